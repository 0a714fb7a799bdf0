"""Tallies of words at fixed places of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_words(docs: DataFrame, *, text: str, end: str = r"\.") -> DataFrame:
    """``(token, n)``: the last word of every sentence that has one, counted; text after the last end counts too."""
    sentences = docs.select(F.explode(F.split(text, end, -1)).alias("s"))
    words = F.filter(F.split("s", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return sentences.select(F.try_element_at(words, F.lit(-1)).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))
