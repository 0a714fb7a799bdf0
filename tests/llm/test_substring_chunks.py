"""Operator 1 over many chunks and partitions, and the parts that chunks are made of."""

import numpy as np

from lectern.llm import substring, textnum


def _rows(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs).collect())


def test_chunks_and_partitions_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, n)) for n in rng.integers(0, 300, 200).tolist()]
    texts += [texts[0] + " " + texts[1], texts[2], None, *[""] * 300, "a " * 90, " ".join(texts[:40])]
    whole = _rows(spark, texts)
    assert sum(r[2] for r in whole) > 5_000
    monkeypatch.setattr(substring, "PARTITION", 12_000)
    monkeypatch.setattr(substring, "SMALL_CHUNK", 1_500)
    assert _rows(spark, texts) == whole


def test_chunks_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([("",)] * 1_000 + [("x" * 3_000,)] + [("y z",)] * 1_000, "text string").selectExpr("1 AS key", "text")
    packed = docs.coalesce(1).mapInArrow(substring._pack(7, 1_600), "part int, name bigint, body binary").collect()
    chunks = [substring._Chunk(bytes(r["body"])) for r in packed]
    assert sum(len(c.texts) for c in chunks) == 2_001 and max(len(c.texts) for c in chunks) <= 100
    assert {r["part"] for r in packed} == set(range(7)) and len({r["name"] for r in packed}) == len(packed)


def test_entries_come_back(spark):
    places = np.sort(np.random.default_rng(5).choice(1 << 31, 1_000, replace=False))
    flags, short = np.arange(1_000, dtype=np.uint8), np.arange(1_000, dtype=np.uint32) * 4_000_000
    for n in (0, 1, 1_000):
        got = substring._expand(substring._squeeze(substring._steps(places[:n]), flags[:n], short[:n]))
        assert [a.tolist() for a in got] == [a[:n].tolist() for a in (places, flags, short)]


def test_word_numbers_do_not_depend_on_blocks(monkeypatch):
    texts = [b"", b"one two", b"  one ", b"", b"two" * 50, b"one two\tone"] * 3
    numbers, bounds = textnum.words(texts)
    monkeypatch.setattr(textnum, "BLOCK_BYTES", 8)
    again, same = textnum.words(texts)
    assert numbers.tolist() == again.tolist() and bounds.tolist() == same.tolist()
    assert textnum.words([])[1].tolist() == [0]


def test_partitions_grow_with_executors(spark, monkeypatch):
    class Session:
        _jvm = spark._jvm

        class sparkContext:  # noqa: N801
            getConf = staticmethod(lambda: settings)

    for settings, want in (({}, 8 << 20), ({"spark.executor.memory": "64g"}, 8 << 20), ({"spark.executor.memory": "56g", "spark.executor.cores": "4"}, 128 << 20), ({"spark.executor.memory": "1g", "spark.executor.cores": "2"}, 8 << 20)):
        assert substring.partition_bytes(Session) == want
