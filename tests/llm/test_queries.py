"""Every registered query keeps its contract's columns and types, and equals its SQL or a plain Python version on the smallest tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lectern.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_substring": "doc_id:bigint,n_words:bigint,n_removed:bigint,kept_sha256:string",
    "op2_html": "page_id:bigint,url:string,text:string,n_chars:bigint",
    "op3_bpe": "doc_id:bigint,n_tokens:bigint,ids_sha256:string,decoded_sha256:string",
    "op4_neardup": "doc_id:bigint,n_shingles:bigint,component_id:bigint,kept:boolean",
    "op5_ann": "query_id:bigint,rank:int,vec_id:bigint,score:double",
    "op6_pii": "doc_id:bigint,n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string",
    "op8_topk": "query_id:bigint,rank:int,vec_id:bigint,score:bigint",
    "op10_langid": "doc_id:bigint,held_out:boolean,lang_pred:string,score:double",
}


def _table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'")


@pytest.fixture(scope="module")
def texts():
    return dict(_table("documents").select("doc_id, text").fetchall())


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def get(name):
        if name not in found:
            df = queries.queries()[name](spark, SF)
            have = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema]
            assert ",".join(have).startswith(CONTRACT.get(name, ""))
            found[name] = df.collect()
        return found[name]

    return get


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(results, name):
    for t in ("documents", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duckdb.sql(queries.oracle_sql()[name])
    rows = results(name)
    assert sorted(tuple(r[c] for c in want.columns) for r in rows) == sorted(want.fetchall())


def test_pages(results):
    rows = {r["page_id"]: r for r in results("op2_html")}
    for page, url, page_html in _table("pages").select("page_id, url, html").fetchall():
        article = re.search("<article>(.*?)</article>", page_html, re.S)[1].replace("<br>", " ")
        import html

        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert (rows[page]["url"], rows[page]["text"], rows[page]["n_chars"]) == (url, want, len(want))


def test_tokens(results, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, sizes = results("op3_bpe"), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        sizes[len(ids)] += 1
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r["n_tokens"]: r["n_docs"] for r in results("op7_lengths")} == sizes
    assert all(r["truncated_total"] == sum(min(n, r["n_tokens"]) * c for n, c in sizes.items()) for r in results("op7_lengths"))


def test_nearest(results):
    ids, x = zip(*_table("embeddings").select("vec_id, embedding").fetchall())
    ids, x = np.array(ids), np.array(x, np.float64)
    by_query = {}
    for r in results("op5_ann"):
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, rows in by_query.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len({r["vec_id"] for r in rows} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and rows == sorted(rows, key=lambda r: (-r["score"], r["vec_id"]))
        assert all(abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-12 for r in rows)
    assert hits >= 0.9 * 20 * len(by_query)


def test_languages(results):
    langs = dict(_table("documents").select("doc_id, lang").fetchall())
    rows = results("op10_langid")
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_draws(results, texts):
    sources = dict(_table("documents").select("doc_id, source").fetchall())
    words = {i: len((t or "").encode().split()) for i, t in texts.items()}
    rows, total, drawn = results("op9_mixing"), Counter(), Counter()
    assert len(rows) == len(texts) and all(r["copies"] == r["passes"] + r["extra"] >= 1 and r["extra"] in (0, 1) for r in rows)
    for r in rows:
        total[sources[r["doc_id"]]] += words[r["doc_id"]]
        drawn[sources[r["doc_id"]]] += words[r["doc_id"]] * r["copies"]
    repeated = {s: drawn[s] / total[s] for s in total}
    assert max(repeated.values()) <= 2.0 * min(repeated.values()) + 1e-9


def test_entry_lists_all(spark):
    assert set(queries.queries()) | {"pipeline", "token_tally"} == set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
