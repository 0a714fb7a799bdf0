"""Personal data in text (operator 6), in DataFrame functions only.

Regular expressions propose spans, validators confirm them, and words shortly before a span adjust its score.
Every pattern is written so that the matching engine never backtracks over a run (possessive loops) and starts only
at the left end of a run, which finds the same spans as the plain forms in the comments but in linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a span in which context words count, and the candidates of a kind (three characters or more with what lies before each) that fit in them.
CONTEXT, WITHIN = 40, 14


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _ip_ok(hit: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))


def _card_ok(hit: Column) -> Column:
    return F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))


def _phone_ok(hit: Column) -> Column:
    return F.length(_digits(hit)).between(9, 15)


def _iban_ok(hit: Column) -> Column:
    """Length 15 to 34 and 1 as the remainder mod 97, the first four characters moved to the end and letters as 10 to 35."""
    packed = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(packed, 5, 34), F.substring(packed, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    )
    return F.length(packed).between(15, 34) & (rest == 1)


def _any(hit: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what proposes it, what confirms it, and how sure a span of it is."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    words: str  # context words before a span
    score: float  # without such a word
    needs: str = ""  # a text without this has none
    least: float = 0.0  # score from which a span counts


#: In the order of the result.  The first four are the base kinds and always count; the others are added by the method.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _any, "mail|contact|write", 0.8, "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip_ok, "ip|address|host|server", 0.6),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card_ok, "card|visa|credit|pay", 0.7),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone_ok, "phone|tel|call|mobile|fax", 0.7, "+"),
    # groups of four; a shorter last one has a digit, so that a word after the number isn't taken for it
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban_ok, "iban|account|bank", 0.7),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", _any, "ssn|social security", 0.3, "-", 0.5),
)
BASE = ("email", "ip", "card", "phone")


PIECE = "struct<skip:bigint,n:bigint,before:string,hit:string>"


def _inside(values: Column, start: Column) -> Column:
    """Sums of all earlier elements, from ``start`` on."""
    return F.aggregate(
        values,
        F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("sums")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["sums"], acc["at"]).alias("sums")),
        lambda acc: acc["sums"],
    )


def _before(pieces: Column, i: Column) -> Column:
    """The ``CONTEXT`` characters of the text before piece ``i`` (from 0), whatever candidates they hold."""
    earlier = F.transform(F.slice(pieces, F.greatest(i - WITHIN, F.lit(0)) + 1, F.least(i, F.lit(WITHIN))), lambda p: F.concat(p["before"], p["hit"]))
    return F.right(F.concat(F.array_join(earlier, ""), F.get(pieces, i)["before"]), F.lit(CONTEXT))


def _each(rows: DataFrame, names: list[str], make: Callable[[Kind], Column], put: str, *take: str) -> DataFrame:
    """``rows`` with the columns ``take`` of every kind replaced by ``put``; a projection of its own, so nothing is computed twice."""
    kept = [c for c in rows.columns if c in names or c.startswith("__") and not any(c == f"__{t}_{k.name}" for t in take for k in KINDS)]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[make(k).alias(f"__{put}_{k.name}") for k in KINDS])


def find(docs: DataFrame, *, text: str = "text", keep: list[str], block: int = 256) -> DataFrame:
    """``keep`` with ``spans``: array of (start, kind_order, end, kind, score, hit), by start and then kind.

    Offsets are code points, the end is exclusive.  Null and empty texts have no spans.  Whole texts are searched, however long; repeated
    rows each get their result, an empty table gives no rows; columns in ``keep`` pass through, one named ``spans`` is replaced, and names that
    begin with two underscores are reserved.  Spans of different kinds may overlap; where they start together the order of ``KINDS`` decides.  Positions are running sums of the lengths of
    matches and of what lies between, in two levels of ``block`` elements, so that a text with very many matches takes linear time.
    """
    names = [c for c in keep if c != "spans"]
    col = lambda kind, name: F.col(f"__{name}_{kind.name}")
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__digit", F.col("__text").rlike("[0-9]"))
    applies = lambda k: F.contains("__text", F.lit(k.needs)) if k.needs else F.col("__digit")
    rows = _each(rows, names, lambda k: F.when(applies(k), F.regexp_extract_all("__text", F.lit(k.pattern), F.lit(0))), "hits")
    # the text between matches is only looked at where a match is confirmed
    rows = _each(rows, names, lambda k: F.when(F.exists(col(k, "hits"), k.confirm), F.split("__text", k.pattern, -1)), "gaps")

    def pieces(k: Kind) -> Column:
        piece = lambda g, h: F.struct(F.length(g).cast("bigint").alias("skip"), F.length(h).cast("bigint").alias("n"), F.right(g, F.lit(CONTEXT)).alias("before"), h.alias("hit"))
        found = F.zip_with(F.slice(col(k, "gaps"), 1, F.size(col(k, "hits"))), col(k, "hits"), piece)
        return F.when(col(k, "gaps").isNotNull(), found).otherwise(F.array().cast(f"array<{PIECE}>"))

    rows = _each(rows, names, pieces, "pieces", "hits", "gaps").drop("__text", "__digit")
    blocks = lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.size(col(k, "pieces")) / block).cast("int")), lambda b: F.slice(F.transform(col(k, "pieces"), lambda p: p["skip"] + p["n"]), b * block + 1, block))
    rows = _each(rows, names, blocks, "blocks")
    totals = lambda k: _inside(F.transform(col(k, "blocks"), lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, n: a + n)), F.lit(0))
    rows = _each(rows, names, totals, "totals")
    rows = _each(rows, names, lambda k: F.flatten(F.zip_with(col(k, "blocks"), col(k, "totals"), _inside)), "starts", "blocks", "totals")

    def spans(k: Kind) -> Column:
        with_word = F.least(F.lit(1.0), F.lit(k.score + 0.3))
        numbered = F.transform(col(k, "starts"), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        near = lambda i: F.lower(_before(col(k, "pieces"), i)).rlike(rf"\b(?:{k.words})")
        span = lambda p, s: F.struct(
            (s["s"] + p["skip"]).alias("start"),
            F.lit([x.name for x in KINDS].index(k.name)).alias("kind_order"),
            (s["s"] + p["skip"] + p["n"]).alias("end"),
            F.lit(k.name).alias("kind"),
            # the context is only looked at where the candidate is confirmed
            F.when(k.confirm(p["hit"]), F.when(near(s["i"]), with_word).otherwise(F.lit(k.score))).alias("score"),
            p["hit"].alias("hit"),
        )
        return F.filter(F.zip_with(col(k, "pieces"), numbered, span), lambda s: s["score"] >= k.least)

    rows = _each(rows, names, spans, "spans", "pieces", "starts")
    return rows.select(*[F.col(f"`{c}`") for c in names], F.array_sort(F.concat(*[col(k, "spans") for k in KINDS])).alias("spans"))


def digest(found: DataFrame, key: str) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans as text, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [of_kind(k) for k in BASE]
    return found.select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every confirmed span replaced by its kind in brackets; other text, nulls and all columns stay as they are.

    Kinds are replaced one after another, each in time linear in the text.
    """
    names = docs.columns
    for kind in KINDS:
        masked = _masked(F.col(f"`{text}`"), kind).alias(text)
        docs = docs.select(*[masked if c == text else F.col(f"`{c}`") for c in names])
    return docs


def _masked(text: Column, kind: Kind) -> Column:
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before"), h.alias("hit")))

    def part(piece: Column, i: Column) -> Column:
        sure = kind.confirm(piece["hit"])
        if kind.score < kind.least:
            sure = sure & F.lower(_before(pieces, i)).rlike(rf"\b(?:{kind.words})")
        return F.concat(piece["gap"], F.when(sure, F.lit(f"[{kind.name.upper()}]")).otherwise(piece["hit"]))

    applies = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]")
    return F.when(applies, F.concat(F.array_join(F.transform(pieces, part), ""), F.element_at(gaps, -1))).otherwise(text)
