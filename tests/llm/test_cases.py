"""Nulls, empty and long texts, ties, repeated rows, empty tables, hot keys and clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, balltree, bpe, langid, lengths, mixing, neardup, pii, substring

EMPTY = "doc_id long, text string, lang string, source string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names_clash(spark):
    rows = [(1, "alpha beta " * 30, "en", "s"), (1, "alpha beta " * 30, "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "gamma delta 10.0.0.1", "en", "t")]
    plain = spark.createDataFrame(rows, EMPTY)
    taken = "id key part body name told n_words n_removed kept n_shingles component_id component rep print sketch bands cell set parts size ids n_tokens decoded spans hit tokens weight partial passes extra copies place before share rank score rejected lang_pred b_tokens c_source c_block n".split()
    clash = plain.select("*", *[F.lit("clash").alias(c) for c in taken])
    makes = [
        lambda d: substring.remove_repeats(d),
        lambda d: neardup.components(d, words=2),
        lambda d: bpe.encode_digest(d, keep=["doc_id"]),
        lambda d: pii.digest(pii.find(d, keep=["doc_id"]), "doc_id"),
        lambda d: langid.identify(d, {"en": b"alpha beta gamma delta " * 9, "de": b"der die das " * 9}, keep=["doc_id"]),
        lambda d: mixing.mix(d.withColumn("words", mixing.word_count(F.col("text"))), tokens="words", key="doc_id", repetition=2.0).select("doc_id", "source", "weight", "passes", "extra", "copies"),
    ]
    for make in makes:
        assert _rows(make(clash)) == _rows(make(plain))
    passed = mixing.mix(clash.withColumn("words", F.lit(2)), tokens="words", key="doc_id", repetition=2.0).collect()
    assert all(r["place"] == r["before"] == r["partial"] == "clash" and isinstance(r["copies"], int) for r in passed)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], EMPTY)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    dictionaries = langid.train_dictionaries(docs)
    assert dictionaries == {}
    for df in (
        substring.remove_repeats(docs), neardup.components(docs), bpe.encode_digest(docs, keep=["doc_id"]), bpe.decode(bpe.encode(docs, keep=["doc_id"]), keep=["doc_id"]),
        pii.find(docs, keep=["doc_id"]), pii.redact(docs), langid.identify(docs, dictionaries), lengths.length_histogram(bpe.lengths(docs, keep=[])),
        mixing.mix(docs.withColumn("n", F.lit(1)), tokens="n", key="doc_id", repetition=2.0), balltree.top_k(vectors), ann.search(vectors),
    ):
        assert df.count() == 0


def test_nothing_learned_or_languages_bounded(spark):
    docs = spark.createDataFrame([(i, "some words here", f"l{i % 3}", "s") for i in range(9)] + [(9, "x", "l0", "s")], EMPTY)
    assert sorted(langid.train_dictionaries(docs, languages=2)) == ["l0", "l1"]
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


def test_long_text_is_not_rejected(spark):
    rng = random.Random(2)
    words = [[f"{a}{n}{b}" for n in range(400)] for a, b in (("th", "ing"), ("sch", "ung"))]
    known = {k: " ".join(rng.choice(w) for _ in range(4000)).encode() for k, w in zip(("en", "de"), words)}
    text = " ".join(rng.choice(words[0]) for _ in range(300_000))
    got = langid.identify(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), known).collect()
    assert [(r["lang_pred"], r["rejected"]) for r in got] == [("en", False)] * 2


def test_personal_data_context_and_rows(spark):
    rows = [
        (1, "SSN: 123-45-6789, 123-45-6780"), (2, "number 123-45-6789"), (2, "number 123-45-6789"), (3, "ssn " + "x" * 60 + " 123-45-6789"),
        (4, "IBAN DE89370400440532013000 Please pay"), (5, "GB82 WEST 1234 5698 7654 32 and more"), (6, "DE89 3704 0044 0532 0130 00 I am"), (7, "a@b.c " * 300 + "ssn 123-45-6789"),
    ]
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]), "doc_id").collect()}
    assert found[1] == "ssn:5:16,ssn:18:29" and found[2] == found[3] == "" and found[4] == "iban:5:27" and found[5] == "iban:0:27" and found[6] == "iban:0:27"
    assert found[7].count("email") == 300 and found[7].endswith("ssn:1804:1815")
    masked = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[1] == "SSN: [SSN], [SSN]" and masked[2] == rows[1][1] and masked[4] == "IBAN [IBAN] Please pay"


def test_near_duplicates_in_parts(spark, monkeypatch):
    """Buckets and components that are too large for a task are split; a hot group of copies and one of near copies."""
    monkeypatch.setattr(neardup, "BUCKET_PART", 6)
    monkeypatch.setattr(neardup, "CELL_SHINGLES", 400)
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(60)]
    texts = {}
    for i in range(40):
        near = list(base)
        near[rng.randrange(60)] = f"x{i}"
        texts[i] = " ".join(near)
    for i in range(40, 90):
        texts[i] = " ".join(base)
    for i in range(90, 140):
        texts[i] = " ".join(f"w{rng.randrange(9000)}" for _ in range(30))
    texts |= {200: None, 201: "", 202: None}
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=5).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts.items() if (w := (t or "").split())}
    top = {i: i for i in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(4):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {i: (top[i], top[i] == i) for i in texts}


def test_vectors_of_all_kinds(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.standard_normal(12)]) for i in range(600)]
    rows += [(600 + i, rows[41][1]) for i in range(300)]  # copies: ties go to the smaller ids
    rows += [(2000 + i, [float(v) for v in rng.standard_normal(5)]) for i in range(45)]  # another length
    rows += [(40, rows[3][1]), (41, rows[41][1])]  # repeated ids
    rows += [(5000, None), (5020, []), (5040, [0.0] * 12), (5060, [1.0, None]), (5080, [float("inf")] * 12)]
    clash = [(i, v, 1, "x", 2.0) for i, v in rows]
    got = ann.search(spark.createDataFrame(clash, "vec_id long, embedding array<double>, id int, vec string, score double")).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    usable = [(i, np.array(v)) for i, v in rows[:-5]]
    assert set(by_query) == {i for i, _ in usable if i % 20 == 0}
    hits = total = 0
    for q, found in by_query.items():
        scored = [(-float(v @ o), i) for own, o in usable if own == q for i, v in usable if i != q and len(v) == len(o)]
        want = [(i, -s) for s, i in sorted(scored)[:20]]
        found = [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])]
        assert len(found) == 20
        hits += len({i for i, _ in found} & {i for i, _ in want})
        total += len({i for i, _ in want})
    assert hits >= 0.9 * total


def test_top_k_of_large_numbers_and_repeated_rows(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(1, 120)] + [(50, [3.0, 1.0]), (51, [9.0, 0.0]), (51, [9.0, 0.0]), (150, [1e13, 0.0]), (151, [-1e13, 0.0])]
    got = balltree.top_k(spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, vec string, dims int"), shard_rows=20).collect()
    points = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    for q in (50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(v, o)), i) for own, o in points if own == q for i, v in points if i != q)[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in best]
    with pytest.raises(Exception, match="fit a long"):
        balltree.top_k(spark.createDataFrame([(50, [1e13]), (51, [1e13])], "vec_id long, embedding array<double>")).collect()


def test_special_tokens_of_any_form(tmp_path, spark):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({"id": 50_257, "content": "[STOP]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = "one [STOP] two<|endoftext|>"
    want = Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    got = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=["doc_id"], path=str(path)).first()["ids"]
    assert np.frombuffer(got, "<u4").tolist() == want


def test_digest_of_nothing(spark):
    got = bpe.encode_digest(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), keep=["doc_id"]).collect()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == {(0, *[hashlib.sha256(b"").hexdigest()] * 2)}


def test_personal_data_sql_on_all_kinds(spark):
    import duckdb
    import pandas as pd

    from lectern.llm.sql import OP6

    texts = [
        None, "", "SSN: 123-45-6789, 123-45-6780 and 000-12-3456", "x123-45-6789 ssn\n123-45-6789é123-45-6789", "DE89370400440532013000 Please, GB82 WEST 1234 5698 7654 32\nDE89 3704 0044 0532 0130 00",
        "DE89370400440532013001", "é😀 social security 123-45-6789-1 123-45-6789", "a@b.c 4111 1111 1111 1111 at 10.0.0.1 or 256.1.1.1, call +1 (456) 555-2186", "ssn " + "y" * 37 + " 123-45-6789",
    ]
    rows = list(enumerate(texts))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    db = duckdb.connect()
    db.register("documents", documents)
    want = db.sql(OP6)
    got = pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]), "doc_id").collect()
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())
    kinds = [s.split(":")[0] for r in got for s in r["spans"].split(",")]
    assert kinds.count("ssn") >= 5 and kinds.count("iban") == 3
