"""Progress of streaming jobs and of long operations, as rows of a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The share of a renaming that is done in scripts, at the glossary, and when pages begin.
SCRIPTS_SHARE, GLOSSARY_AT, PAGES_AT = 0.7, 0.75, 0.8

BATCHES = "query_id string, run_id string, name string, batch long, rows long, rows_per_second double, milliseconds long, at string"


class ProgressTable(StreamingQueryListener):
    """Appends a row to the table at ``path`` for each batch of the session's queries that had
    rows; with ``name``, only for queries of that name.

    A row holds what the engine says of the batch. A batch that is done again after a restart
    is appended again under its new run; ``batches`` shows the last one.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows and self.name in (None, p.name):
            row = (str(p.id), str(p.runId), p.name, p.batchId, p.numInputRows, float(p.processedRowsPerSecond), p.batchDuration, p.timestamp)
            self.spark.createDataFrame([row], BATCHES).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, name, batch, rows, rows_per_second, milliseconds, at), each batch as it was last
    done; empty where nothing was written yet."""
    try:
        found = spark.read.schema(BATCHES).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], BATCHES)
    rest = ["name", "rows", "rows_per_second", "milliseconds", "at"]
    last = found.groupBy("query_id", "batch").agg(F.max_by(F.struct(*rest), F.struct("at", "run_id")).alias("v"))
    return last.select("query_id", "v.name", "batch", *[f"v.{c}" for c in rest[1:]])


def renaming_share(phase: Column, done: Column, total: Column) -> Column:
    """Share, from 0 to 1, of a renaming: scripts first, then the glossary, then pages; ``phase``
    is scripts, glossary, pages or completed, ``done`` of ``total`` counts its parts."""
    part = F.coalesce(done / F.nullif(total, F.lit(0)), F.lit(0.0))
    return (
        F.when(phase == "scripts", part * SCRIPTS_SHARE)
        .when(phase == "glossary", F.lit(GLOSSARY_AT))
        .when(phase == "pages", F.lit(PAGES_AT) + part * (1 - PAGES_AT))
        .when(phase == "completed", F.lit(1.0))
    )
