"""From raw documents to a mixed, encoded corpus in five stages; counted as part of ``lectern.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, langid, mixing, neardup, pii
from lectern.llm.common import checkpointed, table

#: Each source may be repeated at most so many times as often as the least repeated one.
REPETITION = 1.25


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents that it rejects go; ``lang`` stays as given.

    Rejected are texts null, empty or without a letter, and those of 200 bytes or more that fit two languages equally well.  Whole texts
    decide, however long; repeated rows stay or go together, an empty table stays empty, extra columns of any name pass through.
    """
    dictionaries = langid.train_dictionaries(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return langid.identify(rows, dictionaries, keep=["row"]).where(~F.col("rejected")).select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup over five-word shingles at 0.8: the document with the smallest id of each group stays.

    Null and empty texts are linked with nothing and stay.  Rows that share a ``doc_id`` are one document: they stay or go
    together.  An empty table stays empty; extra columns of any name pass through.
    """
    kept = neardup.components(docs.select("doc_id", "text"), words=5, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text.

    A null text stays null, as does its ``n_chars``; every row stays, an empty table stays empty, extra columns of any name pass through.
    """
    masked = pii.redact(docs)
    return masked.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document once at least, those of small sources more often.

    A null source is a source of its own.  Texts null, empty or without words have no tokens; they follow their source's whole passes.  Repeated rows are
    drawn alike, as are rows that share a ``doc_id`` and a source; an empty table stays empty, extra columns of any name pass through.
    """
    slim = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_words"))
    drawn = mixing.mix(slim, tokens="n_words", key="doc_id", repetition=REPETITION).where("copies > 1")
    drawn = drawn.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__of")).agg(F.max("copies").cast("int").alias("__copies"))
    both = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__of")), "left")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.coalesce("__copies", F.lit(1))))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every text, and whether decoding them gives the text back.

    A null text counts as an empty one, with no ids.  Every row has its result, however long its text; an empty table gives no rows, and extra
    columns are left out.
    """
    found = bpe.encode_checked(docs, keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", "exact")


STAGES = [("language", identified), ("near_duplicates", deduplicated), ("personal_data", redacted), ("mixing", mixed), ("encoding", encoded)]

#: Compression, hashed draws and BPE have no SQL; ``tests/llm`` holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is computed once and kept before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
