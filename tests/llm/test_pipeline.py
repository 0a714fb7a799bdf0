"""The pipeline's stages on the smallest tables, and each against plain Python on a fixture of odd rows."""

import corpus_pipeline as cp
from lectern.llm.common import checkpointed


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] <= sizes[4]
    last = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == sizes[4] and all(r["exact"] for r in last)


def _fixture(spark):
    """Rows with nulls, an empty text, exact and near copies, repeated rows, personal data, an odd source and clashing columns."""
    english = "the history of the river and of the towns that lie along it is told in many old books which people read with great interest "
    german = "die Geschichte des Flusses und der Orte die an ihm liegen wird in vielen alten Büchern erzählt die man gerne liest "
    many = [(i, f"{english if i % 2 else german} number {' '.join(str(i * j) for j in range(60))} write to user{i}@mail.example or 10.0.0.{i}", "en" if i % 2 else "de", "big") for i in range(1, 41)]
    near = many[4][1] + " tail"
    rows = [*many, (50, many[4][1], "en", "big"), (51, near, "en", "small"), (52, None, "en", "small"), (53, "", None, None), (54, "12 34 -- 56", "en", "small"), (55, many[6][1] + " one two", None, None)]
    rows += [(56, "a short one", "en", "small")] * 2 + [(57, "mot court", "fr", None)]
    full = [(*r, -1, "x", "y", 1.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, copies string, place string, score double")


def test_stages_against_plain_python(spark):
    import re
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    from lectern.llm import langid

    docs = _fixture(spark)
    stage = dict(cp.STAGES)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    # language: what it rejects goes, all else stays as it was
    kept = stage["language"](spark, docs, None)
    compressors = langid._compressors(langid.train_dictionaries(docs.where(~langid.held_out(cp.F.col("doc_id")))), 9)

    def fits(text):
        if not text or not re.search(r"[^\W\d_]", text):
            return False
        data = text.lower().encode()
        sizes = sorted(len(c.compress(data)) for c in compressors.values())
        return len(data) < 200 or len(sizes) < 2 or sizes[1] > sizes[0]

    assert rows(kept) == sorted((tuple(r) for r in docs.collect() if fits(r["text"])), key=repr)
    kept = checkpointed(kept)
    # near duplicates: by comparing all pairs
    have = kept.collect()
    sets = {}
    for r in have:
        w = r["text"].translate({c: c + 32 for c in range(65, 91)}).split()
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    single = stage["near_duplicates"](spark, kept, None)
    assert rows(single) == sorted((tuple(r) for r in have if top[r["doc_id"]] == r["doc_id"]), key=repr)
    single = checkpointed(single)
    # personal data: base kinds by plain patterns
    clean = checkpointed(stage["personal_data"](spark, single, None))
    want = {}
    for r in single.collect():
        text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", r["text"])
        want[r["doc_id"]] = re.sub(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "[IP]", text)
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["copies"] == "x" for r in clean.collect()) and clean.columns == docs.columns
    # mixing: whole passes and a partial one, within the limit on repetition
    mixed = checkpointed(stage["mixing"](spark, clean, None))
    before, after = Counter(rows(clean)), Counter(rows(mixed))
    assert set(before) == set(after) and all(after[r] % n == 0 for r, n in before.items())
    count = lambda c: {s: sum(len(r[1].split()) * n for r, n in c.items() if r[3] == s) for s in {r[3] for r in c}}
    passes = [count(after)[s] / n for s, n in count(before).items() if n]
    assert max(passes) <= cp.REPETITION * min(passes) + 1e-9
    # encoding: as the library does
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stage["encoding"](spark, docs, None).collect():
        text = {d["doc_id"]: d["text"] for d in docs.collect()}[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(bytes(r["ids"])).cast("I")) == ids and r["n_tokens"] == len(ids) and r["exact"]


def test_stages_of_empty_tables(spark):
    docs = _fixture(spark).limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, None).count() == 0, name
