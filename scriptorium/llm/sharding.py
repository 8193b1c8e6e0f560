"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every row gets a number, and the kept columns are written with it once, so a lost executor
deals the same rows again. The rows stand in ``source_parts`` source partitions. For a
uniform shuffle, the numbers of rows that go from each source partition to each shard
follow a multivariate hypergeometric law. The driver draws that matrix from the partition
sizes alone (source_parts x n_shards integers; both are parameters), each source partition
is permuted locally and cut by its row of the matrix, the rows are exchanged, and every
shard is permuted again; a large shard is permuted by ranges of its keys in many tasks.

Source partition and both permutations are keyed hashes of all kept columns and the row's
number, so rows that repeat an id, or are equal altogether, are dealt as freely as others.

Law ``rows``: shard sizes differ by one row at most.

Defined cases: null text counts as empty (size 16); null ids are dealt like others;
repeated rows are dealt one by one; an empty table gives an empty result; further columns
of the input, whatever their names, are ignored by ``assign``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators.ranking import rank_in_groups
from scriptorium.session import cut, table

ROW_OVERHEAD = 16
#: numpy draws exactly below this population; above it the ratio of uniforms is used.
NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good items among ``sample`` drawn without replacement."""
    if not sample or not good:
        return 0
    if not bad:
        return sample
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    # Stadlober's ratio-of-uniforms rejection, on the smaller class and sample.
    total, few, m = good + bad, min(good, bad), min(sample, good + bad - sample)
    many = total - few
    p = few / total
    mean, sd = m * p + 0.5, math.sqrt((total - m) * sample * p * (1 - p) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
    mode = (m + 1) * (few + 1) // (total + 2)

    def log_weight(k: int) -> float:
        return sum(map(math.lgamma, (k + 1, few - k + 1, m - k + 1, many - m + k + 1)))

    top, end = log_weight(mode), min(min(m, few) + 1, math.floor(mean + 16 * sd))
    while True:
        x, y = 1 - rng.random(), rng.random()
        w = mean + width * (y - 0.5) / x
        if 0 <= w < end and 2 * math.log(x) <= top - log_weight(k := math.floor(w)):
            break
    if good > bad:
        k = m - k
    return k if m == sample else good - k


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows to send from each source partition to each shard, drawn exactly."""
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng = np.random.Generator(np.random.Philox(seed))
    matrix = np.zeros((len(counts), n_shards), dtype=np.int64)
    for i, left in enumerate(counts):
        beyond = sum(room)
        for s in range(n_shards):
            beyond -= room[s]
            take = hypergeometric(rng, room[s], beyond, left)
            matrix[i, s] = take
            room[s] -= take
            left -= take
    return matrix


def assign(
    rows: DataFrame,
    n_shards: int,
    keep: list[Column],
    seed: int = 7,
    rows_per_part: int = 200_000,
    min_parts: int = 64,
    max_parts: int = 65_536,
) -> DataFrame:
    """``keep`` columns of every row with its ``shard`` and gapless ``slot``."""
    spark = rows.sparkSession
    numbered = cut(rows.select(F.struct(*keep).alias("__row")).withColumn("__number", F.monotonically_increasing_id()))
    total = numbered.count()
    n_parts = min(max_parts, max(min_parts, -(-total // rows_per_part)))
    mixed = lambda n: F.xxhash64(F.lit(seed + n), "__number", "__row")
    dealt = numbered.select(F.pmod(mixed(0), F.lit(n_parts)).cast("int").alias("__part"), mixed(1).alias("__first"), mixed(2).alias("__second"), "__number", "__row")
    counts = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # n_parts rows at most
    sizes = [counts.get(i, 0) for i in range(n_parts)]
    ends = communication_matrix(sizes, n_shards, seed).cumsum(axis=1)
    cuts = spark.createDataFrame(
        [(i, e.tolist()) for i, e in enumerate(ends) if sizes[i]],
        T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))]),
    )
    local = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("__first", "__number")))
    sent = local.join(F.broadcast(cuts), "__part").select(  # n_parts rows of n_shards numbers
        F.size(F.filter("__ends", lambda e: e < F.col("__rank"))).alias("shard"), "__second", "__number", "__row"
    )
    placed = rank_in_groups(sent, ["shard"], [F.col("__second"), F.col("__number")], "__slot")
    return placed.select("__row.*", "shard", (F.col("__slot") - 1).cast("long").alias("slot"))


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    documents = table(spark, sf_dir, "documents").select("doc_id", text.cast("binary").alias("body"))
    sized = documents.select(
        "doc_id",
        (F.octet_length("body") + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32("body").alias("text_crc32"),
    )
    shards = assign(sized, 40, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
