"""Search for parts of texts by an index of trigrams.

Each text, in small letters and with two end marks behind it, has a posting for every three
characters in a row. Postings lie in buckets by their first character, sorted by trigram, so
a query reads the buckets of its own trigrams, and inside them the row groups that hold
these. A row fits if it has all trigrams of the query and, on its own text, the query
itself; a query of one or two characters is the beginning of a trigram.

Defined cases: null texts are not indexed and fit nothing; the empty query fits every text;
rows that repeat a key count as one text each, and a key fits if one of them does; their
postings may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
END = "\x00\x00"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(F.substring(gram, 1, 1).cast("binary")), F.lit(BUCKETS)).cast("int")


def _grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), 1))


def write_index(rows: DataFrame, key: str, text: str, path: str) -> None:
    """The index of ``rows(key, text)`` as a table at ``path``."""
    texts = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.concat(F.lower(text), F.lit(END)).alias("low"))
    # Dealt before each text becomes many postings: one file may be one task, and would hold all of them.
    dealt = texts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "low")
    postings = dealt.select("key", F.explode(_grams(F.col("low"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    # By ranges with the key in them: a frequent trigram is as many tasks as it needs.
    ranges = postings.repartitionByRange("bucket", "gram", "key")
    ranges.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def postings_of(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The postings that a query needs: (key, gram)."""
    low = query.lower()
    index = spark.read.parquet(path)
    first = sorted({low[i : i + 1] for i in range(max(1, len(low) - 2))})
    buckets = [r[0] for r in spark.createDataFrame([(c,) for c in first], "c string").select(_bucket(F.col("c"))).collect()]  # a row for each character of the query
    own = index.where(F.col("bucket").isin(buckets))
    if len(low) < 3:
        return own.where(F.col("gram").startswith(low)).select("key", "gram")
    return own.where(F.col("gram").isin(sorted({low[i : i + 3] for i in range(len(low) - 2)}))).select("key", "gram")


def search(rows: DataFrame, key: str, text: str, path: str, query: str) -> DataFrame:
    """The rows whose text, in any case, holds the query."""
    fits = F.contains(F.lower(text), F.lit(query.lower()))
    if not query:
        return rows.where(F.col(text).isNotNull())
    found = postings_of(rows.sparkSession, path, query)
    n = len({query.lower()[i : i + 3] for i in range(max(1, len(query) - 2))})
    candidates = found.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") >= (n if len(query) >= 3 else 1))
    return rows.join(candidates.select(F.col("key").alias("__key")), F.col(key) == F.col("__key"), "left_semi").where(fits)
