"""State of processing: what to do next, progress, outcomes, issue logs, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranking import rank_in_groups
from scriptorium.operators.scan import placed

# The phases in order, and states that are always done again.
PHASES = ["raw", "clean", "json", "html"]
RETRIED = ["failed", "render_failed"]


def eligible(chapters: DataFrame, phase: str) -> DataFrame:
    """Chapters ``(status, ...)`` that a phase has still to process; those without a status too."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}; known: {', '.join(PHASES)}")
    later = PHASES[PHASES.index(phase) :]
    return chapters.where(F.coalesce(F.col("status").isin(RETRIED) | ~F.col("status").isin(later), F.lit(True)))


def progress(chapters: DataFrame, group: list[str]) -> DataFrame:
    """(group..., total, completed, percentage); finished are html and failed ones."""
    done = F.col("status").isin("html", *RETRIED)
    counted = chapters.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(done).alias("completed"))
    return counted.withColumn("percentage", F.coalesce(F.col("completed") * 100.0 / F.nullif("total", F.lit(0)), F.lit(0.0)))


def plan_batch(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Adds ``outcome`` to ``sources(filename, source_hash)``: failed without a source, skipped
    where ``outputs(filename, source_hash)`` has the same hash, else processed."""
    made = outputs.groupBy("filename").agg(F.max_by("source_hash", F.col("source_hash").isNotNull()).alias("made_hash"))
    outcome = F.when(F.col("source_hash").isNull(), "failed").when(F.col("source_hash") == F.col("made_hash"), "skipped").otherwise("processed")
    return sources.join(made, "filename", "left").withColumn("outcome", outcome).drop("made_hash")


def after_phase(chapters: DataFrame, phase: str, done: Column, failed: Column) -> DataFrame:
    """The state table ``(status, error, ...)`` after a phase has run: of the chapters that it
    had to process, those with ``done`` have reached it, those with ``failed`` have failed and
    keep the reason (``failed`` is the error text or null); all others stay as they are."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}; known: {', '.join(PHASES)}")
    later = PHASES[PHASES.index(phase) :]
    due = F.coalesce(F.col("status").isin(RETRIED) | ~F.col("status").isin(later), F.lit(True))
    broken = "render_failed" if phase == PHASES[-1] else "failed"
    status = F.when(due & failed.isNotNull(), broken).when(due & done, phase).otherwise(F.col("status"))
    error = F.when(due & failed.isNotNull(), failed).when(due & done, None).otherwise(F.col("error"))
    return chapters.withColumns({"status": status, "error": error})


def phase_totals(runs: DataFrame, group: list[str]) -> DataFrame:
    """(group..., processed, failed) summed over ``runs(group..., phase, processed, failed)``."""
    return runs.groupBy(*group).agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))


def run_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group..., created, skipped, errors, total, failures) of ``rows(group..., name, outcome)``,
    where ``failures`` lists the names of failed rows in order."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    names = F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", F.col("name"))))
    return rows.groupBy(*group).agg(
        n("processed").alias("created"), n("skipped").alias("skipped"), n("failed").alias("errors"), F.count("*").alias("total"), names.alias("failures")
    )


def newest_first(log: DataFrame, ts: str = "ts", *ties: str) -> DataFrame:
    """A log with the last entry on top."""
    return log.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in ties])


def outcome_counts(rows: DataFrame) -> DataFrame:
    """One row: processed, skipped, failed, total, and whether more than half failed."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    out = rows.agg(n("processed"), n("skipped"), n("failed"), F.count("*").alias("total"))
    return out.withColumn("alarm", F.coalesce(F.col("failed") / F.nullif("total", F.lit(0)) > 0.5, F.lit(False)))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    value = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias("__v")).select(*keys, "__v.*")


def number_issues(errors: DataFrame) -> DataFrame:
    """The first of ``errors(ts, id, chapter, phase, kind)`` for each chapter, phase and kind, with
    ``issue_id`` ISSUE-date-NNN, numbered within the day."""
    key = ["chapter", "phase", "kind"]
    place = F.struct("ts", "id")
    first = errors.groupBy(*key).agg(F.min_by(F.struct("ts", "id"), place).alias("f")).select(*key, "f.ts", "f.id")
    numbered = rank_in_groups(first.withColumn("__day", F.to_date("ts")), ["__day"], [F.col("ts"), F.col("id"), *map(F.col, key)], "__nth")
    issue = F.concat(F.lit("ISSUE-"), F.date_format("ts", "yyyy-MM-dd"), F.format_string("-%03d", "__nth"))
    return numbered.withColumn("issue_id", issue).drop("__day", "__nth")


def paced(calls: DataFrame, group: list[str], arrival: str, delay: float, duration: str | None = None) -> DataFrame:
    """Adds ``start``: calls in order of arrival, each ``delay`` after the end of the one before
    at least; a call ends ``duration`` (a column; none is 0) after its start."""
    took = F.coalesce(F.col(duration), F.lit(0)) if duration else F.lit(0)
    ordered = placed(calls, group, [F.col(arrival), F.col("id")])
    return ordered.with_chain(F.col(arrival), took + F.lit(delay), "start").result()


def placeholders(failed: DataFrame, version: str) -> DataFrame:
    """For ``failed(filename, text, source_hash)``: a record that keeps the text, as two blocks."""
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("content"))
    note = F.concat(F.lit("Transformation failed for "), F.col("filename"))
    return failed.select(
        "filename",
        "source_hash",
        F.lit(f"{version}-failed").alias("model_version"),
        F.array(block("system_notification", note), block("narrator", F.col("text"))).alias("blocks"),
    )


def reading_progress(events: DataFrame) -> DataFrame:
    """(novel_id, chapters_read, current_chapter, updated_at) of ``events(novel_id, chapter_id, ts)``."""
    return events.groupBy("novel_id").agg(
        F.countDistinct("chapter_id").alias("chapters_read"),
        F.max_by("chapter_id", F.struct("ts", "chapter_id")).alias("current_chapter"),
        F.max("ts").alias("updated_at"),
    )
