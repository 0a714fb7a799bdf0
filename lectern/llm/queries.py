"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, balltree, bpe, html, langid, lengths, mixing, neardup, pii, substring
from lectern.llm.common import table
from lectern.llm.sql import oracle_sql as oracle_sql


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 35-word passages that occur more than once."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the 50k byte-level vocabulary."""
    return bpe.encode_digest(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over word pairs at a similarity of 0.8."""
    return neardup.components(table(spark, sf_dir, "documents"), words=2)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings found for every twentieth one."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"]), "doc_id")


def op7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with suffix sums."""
    return lengths.length_histogram(bpe.lengths(table(spark, sf_dir, "documents"), keep=[]))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 5 for every fiftieth embedding."""
    return balltree.top_k(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of every document when sources are mixed with at most twofold repetition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_words"))
    return mixing.mix(docs, tokens="n_words", key="doc_id", repetition=2.0)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the other folds."""
    docs = table(spark, sf_dir, "documents")
    fold = langid.held_out(F.col("doc_id"))
    dictionaries = langid.train_dictionaries(docs.where(~fold))
    found = langid.identify(docs.select("doc_id", "text"), dictionaries, keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring, op2_html, op3_bpe, op4_neardup, op5_ann, op6_pii, op7_lengths, op8_topk, op9_mixing, op10_langid)}
