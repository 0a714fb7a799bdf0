"""Main text of web pages (operator 2).

1. Pages become blocks of text by their structure: what menus, headers, footers, sidebars, notices, adverts, forms, scripts and
   reader comments hold is left out.  Where a page says which part is its article, that part is the text.
2. Every host has a suffix array over the token streams of its pages' texts.  Suffixes that agree in their first ``window`` tokens stand side by side
   in it; those found on a good share of the host's pages are boilerplate.  Tokens that such runs cover go, what
   is left of a block stays.

The array is not held as one but dealt by those first tokens: equal prefixes meet wherever they come from, counted before they are exchanged,
and a host with a third of all pages is spread like any other.  It is built in two steps that lose no suffix.  A run of ``window`` tokens has a sign: of its
runs of ``PART`` tokens the one with the smallest hash, the same wherever the run stands and mostly that of its neighbours too.  Signs are counted first; a
run can't be on more pages than its sign, so only suffixes whose sign is on a good share of the pages, but all of these, go into the array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textnum
from lectern.llm.common import checkpointed, in_small_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav footer aside form button select option label fieldset menu dialog template svg math object canvas audio video head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What may stand in a head; any other tag, or text, ends a head that was left open.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Classes, ids and roles that mark what is not the article; a name of several words counts if each of them is here.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice popup modal overlay newsletter subscribe signup sidebar complementary menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo header masthead comment comments respond disqus share sharing social related widget toolbar pagination pager search skip login".split()
)
#: Marks under which an article is not the page's own, even if the page has no other.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments respond disqus related".split())
#: Marks that count on inline elements of an article too.
ADVERT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
#: Elements of an article whose id can mark them; elsewhere in it ids are only anchors.
CONTAINER = frozenset("aside details div dl fieldset form ol section table ul".split())
#: Tags that a start tag closes if they are open inside the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("html body article main section div nav aside footer header form table ul ol dl td th blockquote".split())


def _names(attributes: str, wanted: tuple[str, ...]) -> list[str]:
    """The names that the ``wanted`` attributes of a tag list, in lower case."""
    return [name for key, value in _ATTRIBUTE.findall(attributes) if key.lower() in wanted for name in value.strip("\"'").lower().split()]


def _marks(names: list[str]) -> tuple[set[str], bool]:
    """The words of those ``names`` that consist of ``MARKS``, and whether all names do."""
    parts = [set(re.findall(r"[a-z]+", name)) for name in names]
    marked = [words for words in parts if words and words <= MARKS]
    return {word for words in marked for word in words}, bool(names) and len(marked) == len(names)


class _Article:
    """An article that stands in no other: what it holds, and what speaks for its being the page's own."""

    def __init__(self, apart: bool):
        self.apart, self.headed, self.blocks = apart, False, []


def _own(articles: list[_Article]) -> list[str]:
    """The blocks of the page's own article: not one set apart by a mark if another isn't, nor one without the page's heading if another has it,
    nor one that is short beside the longest."""
    some = [a for a in articles if not a.apart] or articles
    some = [a for a in some if a.headed] or some
    size = [sum(map(len, a.blocks)) for a in some]
    return [block for a, n in zip(some, size) if 2 * n >= max(size) for block in a.blocks]


def blocks(html: str) -> tuple[list[str], bool]:
    """A page's blocks of text, and whether the page said where its article is.

    An article inside another is a reader's reply to it, as HTML defines, and is left out.
    """
    rest: list[str] = []
    words: list[str] = []
    # tag, left out (1 by a mark only), 2 inside an article, 1 inside a main part; negative under an element left out by a mark
    stack: list[tuple[str, int, int]] = []
    out, inside, at = 0, 0, 0
    mains: dict[int, list[str]] = {1: [], -1: []}
    articles: dict[int, list[_Article]] = {2: [], -2: []}

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            if inside in articles:
                articles[inside][-1].blocks.append(text)
            else:
                if inside in mains:
                    mains[inside].append(text)
                if inside >= 0:
                    rest.append(text)

    def pop_to(place: int) -> None:
        nonlocal out, inside
        flush()
        del stack[place:]
        out, inside = (stack[-1][1], stack[-1][2]) if stack else (0, 0)

    for m in _MARKUP.finditer(html):
        if m.start() < at:
            continue
        if stack and stack[-1][0] == "head" and html[at : m.start()].strip():
            pop_to(len(stack) - 1)
        if m.start() > at and not out:
            words.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK and not out:
                flush()
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == tag:
                    if tag in BLOCK or stack[place][1] != (stack[place - 1][1] if place else 0) or tag in ("article", "main"):
                        pop_to(place)
                    else:
                        del stack[place:]
                        out, inside = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
                    break
            continue
        if stack and stack[-1][0] == "head" and tag not in HEAD:
            pop_to(len(stack) - 1)
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "br" or tag == "wbr":
            words.append(" " if tag == "br" and not out else "")
            continue
        if tag in BLOCK and not out:
            flush()
        closes = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if closes:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] in closes:
                    pop_to(place)
                    break
                if stack[place][0] in BARRIER:
                    break
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        gone, level, attributes = out, inside, m[3]
        within = inside in articles
        if attributes:
            marks, wholly = _marks(_names(attributes, ("class", "id", "role") if not within or tag in CONTAINER else ("class", "role")))
        else:
            marks, wholly = set(), False
        if within:
            if not wholly:
                marks = set()
            elif tag not in BLOCK:
                marks &= ADVERT
            if tag == "h1" and not gone:
                articles[inside][-1].headed = True
        if tag == "article" and not marks & {"comment", "comments"}:
            part = 2
        else:
            part = 1 if tag == "main" or attributes and "main" in _names(attributes, ("role",)) else 0
        if part == 2 and within:
            gone = 2
        elif part and not within and gone < 2:
            # under an element left out by a mark, the page's own only if no part outside such elements is
            level = -part if gone or level < 0 else part
            gone = 0
            if part == 2:
                articles[level].append(_Article(bool(marks)))
        elif tag not in ("html", "body"):
            if tag in LEFT_OUT or tag == "header" and not inside or marks & FOREIGN or attributes and _HIDDEN.search(attributes):
                gone = 2
            elif marks:
                gone = max(gone, 1)
        if gone and not out:
            flush()
        stack.append((tag, gone, level))
        out, inside = gone, level
    if stack and stack[-1][0] == "head" and html[at:].strip():
        pop_to(len(stack) - 1)
    if at < len(html) and not out:
        words.append(unescape(html[at:]))
    flush()
    for sign in (1, -1):
        if articles[2 * sign]:
            return _own(articles[2 * sign]), True
        if mains[sign]:
            return mains[sign], True
    return rest, False


def host(url: Column) -> Column:
    """The host of a URL in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


#: Tokens of the run that is the sign of a longer one.
PART = 4


class _Streams:
    """The token streams of a batch's pages, and every suffix of at least ``window`` tokens."""

    def __init__(self, pages: list[list[str]], window: int):
        self.numbers, bounds = textnum.words([b.encode("utf-8", "surrogatepass") for found in pages for b in found])
        firsts = np.concatenate([[0], np.cumsum([len(found) for found in pages])]).astype(np.int64)
        self.ends = bounds[firsts]  # where each page's tokens begin, and the end
        page = np.repeat(np.arange(len(pages)), np.diff(self.ends))
        heads = textnum.windows(self.numbers, window)
        self.places = np.flatnonzero(page[: len(heads)] == page[window - 1 :])
        self.heads, self.page, self.window = heads[self.places].view(np.int64), page[self.places], window

    def signs(self) -> np.ndarray:
        """The sign of each suffix's head."""
        part = min(PART, self.window)
        parts = textnum.windows(self.numbers, part)
        n = max(0, len(self.numbers) - self.window + 1)
        least = parts[:n].copy()
        for at in range(1, self.window - part + 1):
            np.minimum(least, parts[at : at + n], out=least)
        return least[self.places].view(np.int64)


def _once(numbers: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number of a page once."""
    order = np.lexsort((numbers, page))
    numbers, page = numbers[order], page[order]
    first = np.ones(len(numbers), bool)
    first[1:] = (numbers[1:] != numbers[:-1]) | (page[1:] != page[:-1])
    return numbers[first], page[first]


def _signs(window: int):
    """Each sign of a page once, with the page's site."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _Streams([blocks(h or "")[0] for h in batch.column(1).to_pylist()], window)
            signs = s.signs()
            new = np.ones(len(signs), bool)  # neighbours mostly have the same
            new[1:] = (signs[1:] != signs[:-1]) | (s.page[1:] != s.page[:-1])
            signs, page = _once(signs[new], s.page[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page)), pa.array(signs)], names=["site", "head"])

    return run


def _suffixes(window: int):
    """Each head of a page once whose sign is among those listed, with the page's site."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _Streams([blocks(h or "")[0] for h in batch.column(1).to_pylist()], window)
            signs, cuts = s.signs(), np.searchsorted(s.page, np.arange(batch.num_rows + 1))
            often = np.zeros(len(signs), bool)
            for p, listed in enumerate(batch.column(2)):
                often[cuts[p] : cuts[p + 1]] = np.isin(signs[cuts[p] : cuts[p + 1]], listed.values.to_numpy())
            heads, page = _once(s.heads[often], s.page[often])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page)), pa.array(heads)], names=["site", "head"])

    return run


def _uncovered(window: int, few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(h or "") for h in batch.column(2).to_pylist()]
            texts = ["\n".join(b) for b, _ in found]
            sites = zip(batch.column(3).to_pylist(), batch.column(4))
            which = [(i, heads.values.to_numpy()) for i, (n, heads) in enumerate(sites) if heads.is_valid and not (found[i][1] and n < few)]
            s = _Streams([found[i][0] for i, _ in which], window)
            cuts = np.searchsorted(s.page, np.arange(len(which) + 1))
            for p, (i, heads) in enumerate(which):
                places = s.places[cuts[p] : cuts[p + 1]]
                places = places[np.isin(s.heads[cuts[p] : cuts[p + 1]], heads)] - s.ends[p]
                change = np.zeros(s.ends[p + 1] - s.ends[p] + 1, np.int64)
                np.add.at(change, places, 1)
                np.add.at(change, places + window, -1)
                covered = np.cumsum(change[:-1]) > 0
                # a page covered whole, or an article of which little would be left, is a copy
                if not covered.any() or covered.all() or found[i][1] and 2 * covered.sum() > len(covered):
                    continue
                at, kept = 0, []
                for block in found[i][0]:
                    tokens = block.split(" ")
                    left = [w for w, c in zip(tokens, covered[at : at + len(tokens)].tolist()) if not c]
                    at += len(tokens)
                    if left:
                        kept.append(" ".join(left))
                texts[i] = "\n".join(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


#: Heads or signs that may be broadcast (8 bytes each), and pages that make a site a large one, of which there can't be many.
SMALL, LARGE = 1_000_000, 100_000


def _common(met: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """For each site its ``heads`` of ``met`` on at least two pages and ``share`` of all, as a small table if it is one."""
    # combined on the map side: a head that most pages share is a row per task
    often = checkpointed(met.groupBy("site", "head").agg(F.count("*").alias("n")).where("n > 1"))
    # a large site's heads aren't joined on the site alone
    large = F.broadcast(sizes.where(F.col("pages") > LARGE))
    boiler = F.col("n") >= F.col("pages") * F.lit(share)
    rest = often.join(large.select("site"), "site", "left_anti").join(sizes, "site").where(boiler)
    common = checkpointed(often.join(large, "site").where(boiler).unionAll(rest).groupBy("site", "pages").agg(F.collect_list("head").alias("heads")))
    total = common.agg(F.sum(F.size("heads"))).first()[0] or 0
    return F.broadcast(common) if total <= SMALL else common


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", window: int = 12, share: float = 0.5, few: int = 5) -> DataFrame:
    """``(key, url, text, n_chars)`` of every page.

    ``text`` joins blocks in page order by newlines; white space inside a block is one space, character
    references are decoded, nothing is cut off, however long the page.  Null and empty pages have an empty text, pages cut short end where they end.

    Boilerplate are runs of ``window`` tokens on at least two pages and ``share`` of all pages of their host.  A page that consists of it is a
    copy of others and stays whole.  Inside an article, which the page itself calls its own text, boilerplate goes only on hosts of ``few`` pages or more, and only if it
    makes up no more than half of it.  Pages without a URL are hosts of their own.  Every row counts as a page, repeated rows too;
    nothing depends on the order of rows, and there are no ties.  Extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    slim = in_small_batches(pages).select(F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    slim = slim.withColumn("site", F.xxhash64(host(F.col("url")))).withColumn("site", F.when(host(F.col("url")).isNotNull(), F.col("site")))
    hosted = slim.where("site is not null")
    sizes = checkpointed(hosted.groupBy("site").agg(F.count("*").alias("pages")).where("pages > 1"))
    signs = _common(hosted.select("site", "html").mapInArrow(_signs(window), "site bigint, head bigint"), sizes, share)
    listed = hosted.join(signs, "site").select("site", "html", "heads")
    repeated = _common(listed.mapInArrow(_suffixes(window), "site bigint, head bigint"), sizes, share)
    told = slim.join(repeated, "site", "left").select("page_id", "url", "html", "pages", "heads")
    done = told.mapInArrow(_uncovered(window, few), "page_id bigint, url string, text string")
    return done.select(F.col("page_id").alias(key), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))
