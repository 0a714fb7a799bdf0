"""Language identification by compression (operator 10).

A text is compressed with zstandard once per language, each time primed with a raw-content dictionary of that
language; the language whose dictionary makes the text smallest wins.  Narrow wins are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_small_batches

HAS_LETTER = r"\p{L}"
#: Parts of a language among which its sample is chosen.
PARTS = 256


def train_dictionaries(
    labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 1500, excerpt_chars: int = 300, dictionary_bytes: int = 65536, level: int = 9, languages: int = 256
) -> dict[str, bytes]:
    """Raw-content dictionaries by language, fitted on a bounded sample.

    The bounds are parameters: the ``languages`` most frequent labels are learned, with at most ``docs_per_language`` documents of a language, chosen by a hash of ``key``, with
    ``excerpt_chars`` characters each; a dictionary has at most ``dictionary_bytes`` bytes.  The first
    half of a language's share builds a provisional dictionary; of the rest, excerpts which the provisional
    dictionaries give to another language are left out, so wrong labels do not enter the final dictionaries.
    Rows with null text, null label or no letter are not learned from; no rows give no languages.  Ties go to the smaller hash, key and
    excerpt, so repeated rows do no harm but take places; extra columns are ignored.
    """
    from pyspark.sql import Window

    chosen = [F.xxhash64("key"), F.col("key"), F.col("sample")]
    order = Window.partitionBy("lang").orderBy(*chosen)
    # first within parts of a language, so that the whole of a common one is never in one task
    in_part = Window.partitionBy("lang", "part").orderBy(*chosen)
    learned = labelled.where(F.col(f"`{lang}`").isNotNull()).groupBy(F.col(f"`{lang}`").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    rows = (
        labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").alias("key"), F.lower(F.substring(F.col(f"`{text}`"), 1, excerpt_chars)).alias("sample"))
        .join(F.broadcast(learned), "lang", "left_semi")
        .where(F.col("lang").isNotNull() & F.col("sample").isNotNull() & F.col("sample").rlike(HAS_LETTER))
        .withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(PARTS)))
        .withColumn("rank", F.row_number().over(in_part))
        .where(F.col("rank") <= -(-2 * docs_per_language // PARTS))  # twice an even share; at most so many rows go on
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= docs_per_language)
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        samples.setdefault(r["lang"], []).append(r["sample"])
    first = {k: _joined(v[: max(1, len(v) // 4)], dictionary_bytes) for k, v in samples.items()}
    judge = _compressors(first, level)
    final = {}
    for k, v in samples.items():
        rest = v[max(1, len(v) // 4) :]
        agreed = [s for s in rest if _smallest(judge, s.encode())[0] == k]
        final[k] = _joined(agreed, dictionary_bytes) if len(agreed) * 2 >= len(rest) and agreed else first[k]
    return final


def _joined(samples: list[str], limit: int) -> bytes:
    return " ".join(samples).encode()[:limit]


def _compressors(dictionaries: dict[str, bytes], level: int) -> dict:
    import zstandard as zs

    # no frame extras, so that sizes differ by content alone
    params = zs.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = {}
    for lang in sorted(dictionaries):
        d = zs.ZstdCompressionDict(dictionaries[lang], dict_type=zs.DICT_TYPE_RAWCONTENT)
        if len(dictionaries[lang]) >= 8:
            d.precompute_compress(compression_params=params)
        out[lang] = zs.ZstdCompressor(dict_data=d, compression_params=params)
    return out


def _smallest(compressors: dict, data: bytes) -> tuple[str, int, int]:
    """Best language, its size and the second-best size; ties go to the language first in order."""
    sizes = sorted((len(c.compress(data)), i, lang) for i, (lang, c) in enumerate(compressors.items()))
    return sizes[0][2], sizes[0][0], sizes[1][0] if len(sizes) > 1 else sizes[0][0] + len(data)


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text", keep: list[str] | None = None, level: int = 9, min_gain: int = 1, min_bytes: int = 200
) -> DataFrame:
    """The columns ``keep`` (default: all but clashing ones) with ``lang_pred``, ``score`` and ``rejected``.

    ``score`` is the share by which the winner's size is below the next one's, in 0 to 1.  ``rejected`` is true for
    ``und`` (null text, no letter, or no language learned) and where the winner is less than ``min_gain`` bytes ahead on a text of ``min_bytes``
    or more; on shorter texts whole-byte sizes tie too easily for the margin to mean anything, so the best guess stands.  The margin is
    taken in bytes because a dictionary's gain doesn't grow with the text: as a share of its size every long text's would look narrow.  Ties go
    to the language first in alphabetical order.  Whole texts are compressed, however long; an empty text
    is ``und``.  Repeated rows get the same result each, an empty table gives no rows.  Extra columns pass through; input columns named like an output
    column are replaced.
    """
    own = ["lang_pred", "score", "rejected"]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    chosen = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))
    schema = chosen.drop("__text").schema
    out_schema = type(schema)(schema.fields[:])
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        out_schema = out_schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(HAS_LETTER)
        compressors = _compressors(dictionaries, level)
        for batch in batches:
            lang, score, rejected = [], [], []
            for value in batch.column(batch.num_columns - 1):
                t = value.as_py()
                if not t or not compressors or not letter.search(t):
                    lang.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                data = t.lower().encode("utf-8", "surrogatepass")
                best, least, second = _smallest(compressors, data)
                margin = (second - least) / second
                lang.append(best)
                score.append(min(1.0, max(0.0, margin)))
                rejected.append(second - least < min_gain and len(data) >= min_bytes)
            columns = [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *own])

    return in_small_batches(chosen).mapInArrow(run, out_schema)


def held_out(key: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2
