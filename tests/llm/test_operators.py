"""Operators against brute force on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import ann, balltree, bpe, html, langid, lengths, mixing, neardup, pii, substring
from lectern.llm.common import connected_components

RNG = random.Random(11)
VOCAB = ["alpha", "Beta", "gamma,", "delta", "été", "naïve", "x", "42", "end.", "日本"]


def _text(n):
    return " ".join(RNG.choice(VOCAB) + RNG.choice(["", "", str(RNG.randrange(50))]) for _ in range(n))


def _docs(spark):
    base = [_text(RNG.randrange(1, 160)) for _ in range(40)]
    passage = _text(50)
    texts = [None, "", " \t\n", "one", "One", *base, base[0], base[0], base[1] + " tail", passage + " a", "b " + passage, passage * 3, _text(20_000)]
    texts += ["x " * 200, base[2].replace("alpha", "omega", 1)]
    rows = [(i, t, "a" if i % 3 else None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string"), {r[0]: r[1] for r in rows}


def test_substring(spark):
    docs, texts = _docs(spark)
    words = {k: (t or "").encode().split() for k, t in texts.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    assert len(got) == len(texts)
    for k, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = b"\1" * 35
        assert got[k]["n_words"] == len(w) and got[k]["n_removed"] == sum(gone)
        assert got[k]["kept"].encode() == b" ".join(x for x, g in zip(w, gone) if not g)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def _sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def test_near_duplicates(spark):
    docs, texts = _docs(spark)
    for k in (2, 5):
        sets, top = _sets(texts, k), {i: i for i in texts}
        links = [(a, b) for a in texts for b in texts if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        for _ in texts:
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        got = {r["doc_id"]: r for r in neardup.components(docs, words=k).collect()}
        assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), top[i], top[i] == i) for i in texts}
    assert neardup.components(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    ids = list(range(30))
    RNG.shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (100, 101), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in ids} | {100: 100, 101: 100}


def test_bpe(spark):
    docs, texts = _docs(spark)
    fuzz = ["".join(chr(RNG.choice([RNG.randrange(0x250), RNG.randrange(0x250, 0xD800), RNG.randrange(32, 127)])) for _ in range(40)) for _ in range(150)]
    fuzz += ["a<|endoftext|>b", "<|endoftext|>", "=" * 3000, "  a \n b  ", "\x1c \x85\xa0x"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(fuzz)], "doc_id long, text string")
    texts |= {1000 + i: t for i, t in enumerate(fuzz)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = bpe.encode_digest(docs.select("doc_id", "text").union(more), keep=["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, keep=["doc_id"]), keep=["doc_id"]).collect()
    assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in back)


def test_length_histogram(spark):
    values = [0, 0, 5, 5, 5, 7, 1024, 5000, 5000, None]
    h = lengths.length_histogram(spark.createDataFrame([(v,) for v in values], "n_tokens long"), block=16)
    full = sorted(v or 0 for v in values)
    for r in h.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == full.count(n) and r["docs_ge"] == sum(v >= n for v in full) and r["docs_le"] == sum(v <= n for v in full)
        assert r["tokens_ge"] == sum(v for v in full if v >= n) and r["truncated_total"] == sum(min(v, n) for v in full)
        assert r["share_le"] == r["docs_le"] / len(full) and r["total_tokens"] == sum(full)
    assert [(r[0], r[1], r[2]) for r in lengths.totals_at(h, [6, 2000]).collect()] == [(k, sum(min(v, k) for v in full), sum(v > k for v in full)) for k in (6, 2000)]
    assert [r["n_tokens"] for r in lengths.quantiles(h, [0.1, 0.5, 1.0]).collect()] == [full[math.ceil(p * len(full)) - 1] for p in (0.1, 0.5, 1.0)]


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def _personal(t):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and _luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data(spark):
    parts = ["a", "b.c", "@", ".", "1", "255", "256", "+", "-", " ", "(", ")", "é", "😀", "4111111111111111", "x@y.com", "10.0.0.1", "+1 (456) 555-2186", "_"]
    texts = [None, "", *["".join(RNG.choice(parts) for _ in range(RNG.randrange(1, 40))) for _ in range(400)], "x@y.com " * 1500 + "4111 1111 1111 1111", "9" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.find(docs, keep=["doc_id"]), "doc_id").collect():
        assert r["base_sha256"] == hashlib.sha256(_personal(texts[r["doc_id"]] or "").encode()).hexdigest(), texts[r["doc_id"]]
    added = spark.createDataFrame([(1, "my iban DE89370400440532013000 ok"), (2, "DE89370400440532013001"), (3, "ssn 123-45-6789 and 123-45-6789")], "doc_id long, text string")
    assert [r["spans"] for r in pii.digest(pii.find(added, keep=["doc_id"]), "doc_id").orderBy("doc_id").collect()] == ["iban:8:30", "", "ssn:4:15,ssn:20:31"]
    masked = {r["doc_id"]: r["text"] for r in pii.redact(added.unionAll(docs.where("doc_id < 1"))).collect()}
    assert masked[1] == "my iban [IBAN] ok" and masked[0] is None


def test_top_k_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(700)]
    bad = [(5000, None), (5050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5100, [float("nan")] * 6), (5150, [float("inf")] * 6)]
    got = balltree.top_k(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), shard_rows=150, query_block=8)
    x = np.floor(np.array([r[1] for r in rows]) * 256).astype(np.int64)
    want = set()
    for q in range(0, 700, 50):
        s = x @ x[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:5]
        want |= {(q, n + 1, i, int(s[i])) for n, i in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 24))
    x[300:500] = x[300]  # many equal rows
    x[7] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9020, [float("nan")] * 24)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    s[:, 7] = -np.inf
    assert len(got) == 300 * 20
    assert all(abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9 for r in got)
    kth = np.sort(s, axis=1)[:, -20]
    assert sum(r["score"] >= kth[r["query_id"]] - 1e-9 for r in got) >= 0.9 * len(got)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_mixing(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None, 1 + i % 13) for i in range(3000)] + [(9000, "hot", 0), (9001, "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(docs, tokens="n", key="doc_id", repetition=1.5, blocks=16).collect()
    assert len(got) == len(rows) and all(r["copies"] >= 1 for r in got if r["n"])
    total = Counter()
    for r in rows:
        total[r[1]] += r[2]
    drawn = Counter()
    for r in got:
        drawn[r["source"]] += r["copies"] * r["n"]
    share = {s: t for s, t in total.items() if t}
    spread = max(share.values()) / min(share.values())
    alpha = max(0.0, 1 - math.log(1.5) / math.log(spread))
    least = max(t / t**alpha for t in share.values())
    for s, t in share.items():
        assert least * t**alpha - 14 <= drawn[s] <= least * t**alpha + 1
    entropy = mixing.solve_alpha(mixing.source_totals(docs, source="source", tokens="n"), entropy=math.log(len(share)) - 0.02)
    w = np.array([t**entropy for t in share.values()])
    assert abs(-(w / w.sum() * np.log(w / w.sum())).sum() - (math.log(len(share)) - 0.02)) < 1e-3
    assert mixing.mix(docs.limit(0), tokens="n", key="doc_id", repetition=2.0).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = langid.identify(docs, langid.train_dictionaries(docs.where(~langid.held_out(F.col("doc_id")))))
    test = found.where(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred", "rejected").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in test) >= 0.97 * len(test)
    assert sum(r["rejected"] for r in test) <= 0.005 * len(test)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 34"), (4, "the and of that")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, {"en": b"the and of that with for " * 20, "de": b"der die und das mit nicht " * 20}).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert langid.train_dictionaries(docs.limit(0)) == {}


def test_pages(spark):
    filler = " ".join(f"boiler{i}" for i in range(12))
    rows = [
        (1, "http://H.example/a", '<nav>menu</nav><article><h1>T &amp; U</h1><p>one\n <b>two</b><p class="ad">no</p><p>x&nbsp;y</article><footer>f</footer>'),
        (2, None, None),
        (3, "", ""),
        (4, "http://h2.example/1", f"<p>{filler} first own words</p><script>a<b</script>"),
        (5, "http://h2.example/2", f"<p>{filler}</p><p>second own words</p>"),
        (6, "http://h3.example/2", f"<p>{filler}</p>"),
        (7, "x", '<main>kept<div id="comments">gone</div></main>cut <p'),
    ]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: "T & U\none two\nx y", 2: "", 3: "", 4: "first own words", 5: "second own words", 6: filler, 7: "kept"}
    assert got == {k: (t, len(t)) for k, t in want.items()}
