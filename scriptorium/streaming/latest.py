"""The latest row of each key of a stream, as keyed state that writes changed keys only.

Rows are combined inside each task first, so a hot key reaches its state as one row for
each batch of a task. The state of a key is its latest row by the order columns; a late row
that does not exceed it changes nothing and is not written. With a time to live, keys that
have not changed for so long are forgotten, and what comes later counts as new.

Changed rows are appended under the number of their batch. A batch that is done again after
a restart replaces its own rows, and as the greatest order wins on reading, too, a batch that
broke off shows nothing wrong. ``compact`` gathers what is there into one base.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Keyed state needs the RocksDB store; without empty batches a run over what has arrived ends
#: although a time to live waits.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The settings that a query with keyed state starts with; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LatestWins(StatefulProcessor):
    """Keeps a key's latest row by ``order`` and gives it on when it changes."""

    def __init__(self, keys: list[str], order: list[str], schema: T.StructType, ttl: timedelta | None):
        self.keys, self.order, self.names, self.ttl = keys, order, schema.names, ttl
        self.kept = T.StructType([f for f in schema.fields if f.name not in keys])

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.ttl.total_seconds() * 1000) if self.ttl else None
        self.state = handle.getValueState("latest", self.kept, ttl)

    def _place(self, values: dict) -> list[tuple]:
        return [(values[c] is not None, values[c]) for c in self.order]  # nulls first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.state.get() if self.state.exists() else None
        best = dict(zip(self.kept.names, old, strict=True)) if old is not None else None
        changed = False
        for row in rows:
            new = {c: row[c] for c in self.kept.names}
            if best is None or self._place(new) > self._place(best):
                best, changed = new, True
        if changed:
            self.state.update(tuple(best[c] for c in self.kept.names))
            named = best | dict(zip(self.keys, key, strict=True))
            yield Row(*self.names)(*[named[c] for c in self.names])

    def close(self) -> None:
        pass


def _combined(keys: list[str], order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in order], null_placement="at_start"))
            numbered = rows.select(keys).append_column("__n", pa.array(range(rows.num_rows), pa.int64()))
            last = numbered.group_by(keys, use_threads=False).aggregate([("__n", "max")]).column("__n_max")
            yield from rows.take(last).to_batches()

    return run


def latest_of(events: DataFrame, keys: list[str], order: list[str], ttl: timedelta | None = None) -> DataFrame:
    """The stream of changed latest rows of ``events``; ``order`` should tell the rows of a key
    apart. Timestamps are whole microseconds inside the state, whatever the session's zone."""
    times = [f.name for f in events.schema if isinstance(f.dataType, T.TimestampType)]
    plain = events.withColumns({c: F.unix_micros(c) for c in times})
    combined = plain.mapInArrow(_combined(keys, order), plain.schema)
    processor = LatestWins(keys, order, plain.schema, ttl)
    changed = combined.groupBy(*keys).transformWithState(processor, plain.schema, "Update", "ProcessingTime" if ttl else "None")
    return changed.withColumns({c: F.timestamp_micros(c) for c in times})


def maybe_read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _with_epoch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])


def run_latest(events: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str, ttl: timedelta | None = None) -> StreamingQuery:
    """Runs over what has arrived and appends changed rows under ``target``; returns the ended query."""
    spark = events.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/changes/epoch={epoch}")

    with state_store(spark):
        job = latest_of(events, keys, order, ttl).writeStream.outputMode("update").foreachBatch(write)
        query = job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _base(spark: SparkSession, target: str, schema: T.StructType) -> tuple[DataFrame | None, int]:
    """The newest base and the epoch up to which it holds."""
    found = maybe_read(spark, f"{target}/base", T.StructType([*_with_epoch(schema).fields, T.StructField("upto", T.LongType())]))
    last = found.agg(F.max("upto")).first()[0] if found is not None else None
    return (None, -1) if last is None else (found.where(F.col("upto") == last).drop("upto"), last)


def read_latest(spark: SparkSession, target: str, schema: T.StructType, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, from the base and the changes after it."""
    base, upto = _base(spark, target, schema)
    changes = maybe_read(spark, f"{target}/changes", _with_epoch(schema))
    parts = [p for p in (base, changes.where(F.col("epoch") > upto) if changes is not None else None) if p is not None]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    kept = [c for c in schema.names if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("v"))
    return best.select(*[F.col(c) if c in keys else F.col(f"v.{c}").alias(c) for c in schema.names])


def compact(spark: SparkSession, target: str, schema: T.StructType, keys: list[str], order: list[str]) -> int:
    """Writes the latest rows as a new base and returns the epoch that it holds; rows of that base
    and changes after it are all that is read then. Run it between runs of the stream."""
    changes = maybe_read(spark, f"{target}/changes", _with_epoch(schema))
    last = changes.agg(F.max("epoch")).first()[0] if changes is not None else None
    if last is None:
        return -1
    rows = read_latest(spark, target, schema, keys, order).withColumn("epoch", F.lit(last).cast("long"))
    rows.write.mode("overwrite").parquet(f"{target}/base/upto={last}")
    return last
