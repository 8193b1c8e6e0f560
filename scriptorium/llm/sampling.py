"""Bounded samples of labelled rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, most: dict[int, int], seed: int = 5) -> DataFrame:
    """(doc_id, text, label) of at most ``most[label]`` labelled documents for each label.

    The ids with the smallest keyed hashes are taken, so the sample depends on nothing but
    ids and seed. Labels that contradict each other for one id count as 1. The chosen ids
    number sum(most.values()) at most, which bounds what is broadcast; of repeated
    documents one row stays.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    lots = [one.where(F.col("label") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n) for y, n in most.items()]
    chosen = reduce(DataFrame.unionAll, lots)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def hashed_lot(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, those whose ``doc_id`` has the smallest keyed hashes."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
