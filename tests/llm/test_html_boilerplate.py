"""Operator 2's suffix array against counting every run of every page."""

import random
from collections import defaultdict

from lectern.llm import html


def _brute(pages, window=12, share=0.5, few=5):
    """Texts by url: every run of ``window`` tokens is counted, not only those of the sparse array."""
    hosts, texts = defaultdict(list), {}
    for i, (url, page) in enumerate(pages):
        found, marked = html.blocks(page or "")
        tokens = [b.split(" ") for b in found]
        hosts[url.split("/")[2] if url else f"none {i}"].append((i, tokens, marked))
    for members in hosts.values():
        on = defaultdict(set)
        flat = {i: [w for b in tokens for w in b] for i, tokens, _ in members}
        for i, words in flat.items():
            for at in range(len(words) - window + 1):
                on[tuple(words[at : at + window])].add(i)
        for i, tokens, marked in members:
            words = flat[i]
            covered = [False] * len(words)
            for at in range(len(words) - window + 1):
                if len(on[tuple(words[at : at + window])]) >= max(2, share * len(members)):
                    covered[at : at + window] = [True] * window
            if all(covered) or marked and (len(members) < few or 2 * sum(covered) > len(covered)):
                covered = [False] * len(words)
            at, kept = 0, []
            for block in tokens:
                left = [w for w, c in zip(block, covered[at : at + len(block)]) if not c]
                at += len(block)
                if left:
                    kept.append(" ".join(left))
            texts[i] = "\n".join(kept)
    return texts


def _words(rng, n):
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))


def test_boilerplate_of_a_host(spark):
    rng = random.Random(3)
    notice, legal, shared = _words(rng, 25), [_words(rng, 7) for _ in range(4)], _words(rng, 40)
    pages = []
    for i in range(30):  # a notice in every article, several short blocks after it in most, a passage that few pages share
        own = [f"<p>{_words(rng, rng.randrange(20, 90))}</p>" for _ in range(rng.randrange(2, 5))]
        box = f'<div class="box-{i}">{notice}</div>'
        tail = "".join(f"<p>{x}</p>" for x in legal) if i % 3 else ""
        some = f"<p>{shared}</p>" if i < 4 else ""
        pages.append((f"http://a.example/{i}", f"<nav>menu</nav><article><h1>t{i}</h1>{''.join(own)}{box}{tail}{some}</article>"))
    pages += [pages[0]] * 3  # repeated rows
    pages += [(f"http://b.example/{i}", f"<article><p>{shared} {notice}</p></article>") for i in range(6)]  # copies stay whole
    pages += [(f"http://c.example/{i}", f"<article><p>{notice}</p><p>{_words(rng, 60)}</p></article>") for i in range(3)]  # too few pages
    pages += [(f"http://d.example/{i}", f"<div>{notice}</div><p>{_words(rng, 30 + i)}</p>") for i in range(4)]  # no article
    pages += [(None, f"<p>{notice}</p><p>{_words(rng, 9)}</p>") for _ in range(4)] + [("http://a.example/x", None), ("http://e.example/", "")]
    pages += [("http://f.example/1", f"<article>{_words(rng, 60_000)}</article>")]
    rows = [(i, u, h, "clash", 1) for i, (u, h) in enumerate(pages)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, heads int")
    got = {r["page_id"]: r["text"] for r in html.extract(docs).collect()}
    want = _brute(pages)
    assert got == want
    assert all(notice not in got[i] for i in range(30)) and all(shared in got[i] for i in range(4))
    assert all(notice in got[i] for i in range(33, 42)) and all(notice not in got[i] for i in range(42, 46)) and all(notice in got[i] for i in range(46, 50))
    assert html.extract(docs.limit(0)).count() == 0


def test_run_inside_a_block_goes_but_for_its_ends(spark):
    rng = random.Random(4)
    run = _words(rng, 60)
    pages = [(i, "http://a.example/", f"<p>{_words(rng, 30)} {run} {_words(rng, 30)}</p>") for i in range(5)]
    for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        left = set(r["text"].split()) & set(run.split())
        assert len(left) <= 22 and r["n_chars"] == len(r["text"])


def test_every_position_counts(spark):
    # runs at any place of a block, of exactly the window and longer, some over block ends, none left or cut at an end
    rng = random.Random(8)
    runs = [_words(rng, n) for n in (12, 13, 17, 30, 60)]
    pages = []
    for i in range(40):
        own = []
        for run in runs:
            if rng.random() < 0.7:
                words = run.split()
                cut = rng.randrange(1, len(words)) if i % 4 == 0 else len(words)
                own.append(f"<p>{_words(rng, rng.randrange(1, 40))} {' '.join(words[:cut])}{'</p><p>' if cut < len(words) else ' '}{' '.join(words[cut:])} {_words(rng, rng.randrange(1, 40))}</p>")
        rng.shuffle(own)
        pages.append((f"http://{'ab'[i % 2]}.example/{i}", f"<p>{_words(rng, 50)}</p>" + "".join(own)))
    pages += [(f"http://c.example/{i}", f"<p>{_words(rng, 5)} {runs[0]} {_words(rng, 5)}</p>") for i in range(2)]
    docs = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(docs).collect()}
    assert got == _brute(pages)
    assert all(not set(runs[0].split()) & set(got[i].split()) for i in (40, 41))
