"""The library of novels and chapters: listing, navigation, upkeep.

novels ``(id, title, status, updated_at, ...)``; chapters ``(id, novel_id, chapter_index,
filename, title)``, where a null novel_id marks rows from before there were novels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranking import rank_in_groups
from scriptorium.operators.scan import placed


def chapter_counts(chapters: DataFrame) -> DataFrame:
    return chapters.where("novel_id is not null").groupBy("novel_id").agg(F.count("id").alias("chapter_count"))


def novels_with_counts(novels: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every novel with its number of chapters, counted before the join."""
    counts = chapter_counts(chapters)
    joined = novels.join(counts, novels["id"] == counts["novel_id"], "left")
    return joined.select(*[novels[c] for c in novels.columns], F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"))


def page(novels: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the list, last updated first, then by id."""
    return novels.orderBy(F.col("updated_at").desc(), "id").offset(offset).limit(limit)


def page_with_status(novels: DataFrame, status: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows of one page that have the status: the page is cut first."""
    return page(novels, limit, offset).where(F.col("status") == status)


def same_key(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Null-safe equality over key columns."""
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out


def orphans(chapters: DataFrame, novels: DataFrame) -> DataFrame:
    """Chapters of novels that do not exist."""
    return chapters.where("novel_id is not null").join(novels, chapters["novel_id"] == novels["id"], "left_anti")


def missing_files(chapters: DataFrame, files: DataFrame, path: Column) -> DataFrame:
    """Chapters whose ``path`` is not among ``files(path)``."""
    return chapters.withColumn("path", path).join(files.select("path"), "path", "left_anti")


def without_novels(rows: DataFrame, gone: DataFrame, key: str = "novel_id") -> DataFrame:
    """Rows that remain when the novels of ``gone(id)`` are deleted with all that is theirs."""
    return rows.join(gone.select(F.col("id").alias("__gone")), rows[key] == F.col("__gone"), "left_anti")


def neighbour_ids(chapters: DataFrame) -> DataFrame:
    """Adds ``prev_id`` and ``next_id`` in reading order within the novel (old rows among
    themselves); no novel is one task."""
    ordered = placed(chapters, ["novel_id"], [F.col("chapter_index"), F.col("id")])
    return ordered.with_neighbours(F.col("id"), "prev_id", "next_id").result()


def adopt(chapters: DataFrame, novel_id: int) -> DataFrame:
    """Old rows given to a novel; a second run changes nothing. Adds ``adopted``."""
    return chapters.withColumns({"adopted": F.col("novel_id").isNull(), "novel_id": F.coalesce("novel_id", F.lit(novel_id))})


def database_info(novels: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row: novels, chapters, old rows, novels that have chapters."""
    have = chapters.groupBy("novel_id").count()
    by_novel = have.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("chapters"),
        F.coalesce(F.sum(F.when(F.col("novel_id").isNull(), F.col("count"))), F.lit(0)).alias("legacy_chapters"),
        F.count("novel_id").alias("novels_with_chapters"),
    )
    return novels.agg(F.count("*").alias("novels")).crossJoin(by_novel)  # one row each


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], id_column: str = "id") -> DataFrame:
    """``table`` with each row of ``changes`` put in place of the row with the same keys (null
    equals null) and its id, or added with the next ids in order of keys. Of changes with
    equal keys the one with the greatest values holds."""
    values = [c for c in table.columns if c not in (*keys, id_column)]
    new = changes.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(F.struct(*values)).alias("__new"))
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    old = table.withColumn("__old", F.lit(True))
    both = old.join(new, match, "full")
    fresh = F.col("__old").isNull()
    top = table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("__top"))
    added_rows = both.where(fresh).withColumn("__all", F.lit(0))
    numbered = rank_in_groups(added_rows, ["__all"], [F.col(f"__{k}") for k in keys], "__n").crossJoin(F.broadcast(top))
    kept = both.where(~fresh)
    pick = lambda c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    old_rows = kept.select(*[pick(c) if c in values else F.col(c) for c in table.columns])
    added = {id_column: (F.col("__top") + F.col("__n")).alias(id_column)} | {k: F.col(f"__{k}").alias(k) for k in keys}
    new_rows = numbered.select(*[added[c] if c in added else F.col(f"__new.{c}").alias(c) for c in table.columns])
    return old_rows.unionByName(new_rows)


def update_fields(table: DataFrame, row_id: int, allowed: list[str], now: Column, **fields) -> DataFrame:
    """Sets the allowed fields of one row and its time of change; other fields are ignored."""
    use = {k: v for k, v in fields.items() if k in allowed}
    if not use:
        return table
    hit = F.col("id") == row_id
    changes = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in use.items()}
    return table.withColumns(changes | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def append_rows(table: DataFrame, rows: DataFrame, id_column: str = "id", order: list[str] | None = None) -> DataFrame:
    """``rows`` (without ids) added with the next ids, in ``order``."""
    top = table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("__top"))
    keys = order or [c for c in table.columns if c != id_column]
    numbered = rank_in_groups(rows.withColumn("__all", F.lit(0)), ["__all"], [F.col(k) for k in keys], "__n")
    return table.unionByName(numbered.crossJoin(F.broadcast(top)).withColumn(id_column, F.col("__top") + F.col("__n")).select(*table.columns))


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the table does not have, one for each key."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def by_id(rows: DataFrame, row_id: int) -> DataFrame:
    """The row with the id, or none."""
    return rows.where(F.col("id") == row_id)


def chapters_of(chapters: DataFrame, novel_id: int | None) -> DataFrame:
    """A novel's chapters in reading order; without a novel, the old rows."""
    return chapters.where(F.col("novel_id").eqNullSafe(F.lit(novel_id).cast("bigint"))).orderBy("chapter_index", "id")


def belonging(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """Adds ``found`` to ``requests(novel_id, chapter_id, ...)``: whether the chapter is one of
    the novel's."""
    own = chapters.select(F.col("id").alias("__c"), F.col("novel_id").alias("__n")).where("__n is not null").distinct()
    hit = (F.col("chapter_id") == F.col("__c")) & (F.col("novel_id") == F.col("__n"))
    return requests.join(own, hit, "left").withColumn("found", F.col("__c").isNotNull()).drop("__c", "__n")


def moved_to(chapters: DataFrame, moves: DataFrame) -> DataFrame:
    """Chapters given to other novels by ``moves(chapter_id, novel_id)``; of repeated moves the
    one to the greatest novel id holds. A null novel makes an old row of the chapter."""
    to = moves.groupBy(F.col("chapter_id").alias("__c")).agg(F.max("novel_id").alias("__to"))
    joined = chapters.join(to, F.col("id") == F.col("__c"), "left")
    return joined.withColumn("novel_id", F.when(F.col("__c").isNotNull(), F.col("__to")).otherwise(F.col("novel_id"))).drop("__c", "__to")


def overall_status(states: DataFrame) -> DataFrame:
    """(novel_id, overall) from ``(novel_id, status)`` rows of phases; no phase has a status: not started."""
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    return states.groupBy("novel_id").agg(
        F.when(F.count("status") == 0, "not_started")
        .when(F.bool_and(done), "completed")
        .when(F.bool_or(F.col("status") == "failed"), "failed")
        .when(F.bool_or(F.col("status") == "running"), "running")
        .otherwise("in_progress")
        .alias("overall")
    )
