"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows are handed to and from Python in pieces of about so many bytes of text.
PIECE_BYTES = 2 << 20
#: Rows of an Arrow batch at most, as texts may be long.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about PIECE_BYTES of ``column``, one row at least."""
    for batch in batches:
        size, at = max(1, batch.column(column).nbytes), 0
        rows = max(1, batch.num_rows * PIECE_BYTES // size) if size > PIECE_BYTES else max(1, batch.num_rows)
        while at < batch.num_rows:
            yield batch.slice(at, rows)
            at += rows


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hand what former tasks of this worker have freed back to the system; workers are used again
    for stages of other kinds, and an executor's memory is shared by all of them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, schema: T.StructType | str, step: Callable[[pa.RecordBatch], dict], column: str = "text") -> DataFrame:
    """``step`` turns each piece into columns of ``schema`` by name."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.names
    spark_schema = schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        arrow = to_arrow_schema(spark_schema)
        for piece in pieces(batches, column):
            made = step(piece)
            arrays = []
            for n in names:
                x, kind = made[n], arrow.field(n).type
                arrays.append(x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_column_of_text(df: DataFrame, name: str, kind: T.DataType, step: Callable[[list[bytes]], object]) -> DataFrame:
    """All columns of ``df(text, ...)`` and ``name``, which ``step`` makes of the texts."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    columns = df.columns

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(n) for n, c in enumerate(columns)} | {name: step(texts(batch))}

    return map_arrow(df, schema, run)
