"""A table of states by key: hash buckets, an epoch for each write, and a log of commits.

Rows lie in ``rows/bucket=B/epoch=E``. A write of epoch E reads the buckets of the keys that
change, merges the changes in, and writes these buckets anew under E; other buckets stay as
they are. Then one line in the commit log makes the epoch visible: of each bucket the newest
committed epoch is read. A write that broke off has no line there, so readers see the former
epoch, and when it is done again its files replace those it left (dynamic partition
overwrite).

Defined cases: null keys are keys; of changes with equal keys the one with the greatest
values holds; a write without changes commits an empty epoch; a table that has no commits
is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators.state import after_phase, eligible
from scriptorium.streaming.latest import maybe_read

COMMITS = "epoch long, note string, buckets array<int>"


@dataclass(frozen=True)
class StateTable:
    """A table at ``path`` with ``keys`` among the columns of ``schema``; one writer at a time."""

    spark: SparkSession
    path: str
    keys: list[str]
    schema: T.StructType
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def commits(self) -> DataFrame:
        """(epoch, note, buckets) of the epochs that were finished."""
        found = maybe_read(self.spark, f"{self.path}/commits", COMMITS)
        return found if found is not None else self.spark.createDataFrame([], COMMITS)

    def last_epoch(self) -> int:
        """The newest finished epoch, -1 before the first."""
        last = self.commits().agg(F.max("epoch")).first()[0]
        return -1 if last is None else last

    def _stored(self, as_of: int | None, only: list[int] | None = None) -> DataFrame | None:
        kept = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("epoch", T.LongType())])
        rows = maybe_read(self.spark, f"{self.path}/rows", kept)
        if rows is None:
            return None
        log = self.commits() if as_of is None else self.commits().where(F.col("epoch") <= as_of)
        newest = log.select("epoch", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("epoch").alias("epoch"))
        if only is not None:
            newest, rows = newest.where(F.col("bucket").isin(only)), rows.where(F.col("bucket").isin(only))
        return rows.join(F.broadcast(newest), ["bucket", "epoch"])  # a row for each bucket

    def read(self, as_of: int | None = None) -> DataFrame:
        """The rows as of an epoch, or as they are."""
        stored = self._stored(as_of)
        return self.spark.createDataFrame([], self.schema) if stored is None else stored.select(*self.schema.names)

    def upsert(self, changes: DataFrame, epoch: int, note: str = "") -> None:
        """Puts ``changes`` (all columns) in place of the rows with their keys, as a new epoch."""
        if epoch <= self.last_epoch():
            raise ValueError(f"epoch {epoch} is not after {self.last_epoch()}")
        values = [c for c in self.schema.names if c not in self.keys]
        typed = changes.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        new = typed.groupBy(*self.keys).agg(F.max(F.struct(*values)).alias("__new")).withColumn("bucket", self._bucket())
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # self.buckets at most
        if touched:
            stored = self._stored(None, touched)
            old = self.spark.createDataFrame([], self.schema) if stored is None else stored.select(*self.schema.names)
            left = new.select(*[F.col(k).alias(f"__{k}") for k in self.keys], "__new")
            match = F.lit(True)
            for k in self.keys:
                match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
            both = old.withColumn("__old", F.lit(True)).join(left, match, "full")
            fresh = F.col("__new").isNotNull()
            merged = both.select(
                *[F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) if c in self.keys else F.when(fresh, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in self.schema.names]
            )
            placed = merged.withColumns({"bucket": self._bucket(), "epoch": F.lit(epoch).cast("long")})
            writer = placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("bucket", "epoch").parquet(f"{self.path}/rows")
        self._commit(epoch, note, sorted(touched))

    def _commit(self, epoch: int, note: str, touched: list[int]) -> None:
        line = self.spark.createDataFrame([(epoch, note, touched)], COMMITS).coalesce(1)
        line.write.mode("append").parquet(f"{self.path}/commits")


#: Of the chapters a phase has to process: (keys..., done boolean, failed string or null).
Phase = Callable[[DataFrame], DataFrame]


def run_phases(table: StateTable, phases: list[tuple[str, Phase]]) -> list[str]:
    """Runs the phases that the table's log does not have yet, each as one epoch, and returns
    their names. The table's columns hold ``status`` and ``error``; a phase sees its eligible
    chapters, and only buckets of chapters whose state changes are written anew."""
    done = {r["note"] for r in table.commits().select("note").collect()}  # an entry for each epoch
    ran = []
    for name, phase in phases:
        if name in done:
            continue
        states = table.read()
        results = phase(eligible(states, name)).select(*[F.col(k).alias(f"__{k}") for k in table.keys], F.col("done").alias("__done"), F.col("failed").alias("__failed"))
        match = F.lit(True)
        for k in table.keys:
            match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        joined = states.join(results, match).withColumns({"__status": F.col("status"), "__error": F.col("error")})
        after = after_phase(joined, name, F.coalesce(F.col("__done"), F.lit(False)), F.col("__failed"))
        changed = ~(F.col("status").eqNullSafe(F.col("__status")) & F.col("error").eqNullSafe(F.col("__error")))
        table.upsert(after.where(changed).select(*table.schema.names), table.last_epoch() + 1, name)
        ran.append(name)
    return ran
