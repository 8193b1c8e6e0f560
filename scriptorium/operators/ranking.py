"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut


def rank_in_groups(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1 for the first row of its group in ``order``, and so on.

    Rows are dealt by ranges of (group, order), so one large group is spread over many
    tasks; each range is ranked by itself and moved on by the rows of its group in the
    ranges before, of which there is one count for each range.
    """
    dealt = df.withColumns({f"__o{n}": c for n, c in enumerate(order)})
    keys = [f"__o{n}" for n in range(len(order))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(dealt.repartitionByRange(parts, *group, *keys).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*group, "__range").count()
    offsets = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__range").alias("__r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*keys)))
    same = F.col("__range") == F.col("__r")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return local.join(offsets, same).select(*df.columns, (F.col("__local") + F.col("__before")).alias(name))
