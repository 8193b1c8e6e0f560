"""Ordered scans over groups of any size: neighbours, running sums, chains of waiting.

``placed`` deals rows by ranges of (group, order) and writes them once, so a hot group is
spread over many tasks and the ranges stay what they are. Each range is then scanned by
itself; what it hands on to the next range of its group (first and last row, a sum, a sum
and a maximum) is one row for each range and group. These rows are scanned over the ranges
of a group, of which there are as many as partitions at most, and only groups that lie in
several ranges get a carry at all: two for each border between ranges at most, which bounds
what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scriptorium.session import cut


@dataclass
class Placed:
    """Rows with their range (``__range``) and order (``__o0``, ...), and what they hold besides."""

    rows: DataFrame
    group: list[str]
    keys: list[str]
    columns: list[str]

    def window(self) -> WindowSpec:
        """The rows of a group inside one range, in order."""
        return Window.partitionBy(*self.group, "__range").orderBy(*self.keys)

    def with_columns(self, more: dict[str, Column]) -> Placed:
        return Placed(self.rows.withColumns(more), self.group, self.keys, [*self.columns, *[c for c in more if c not in self.columns]])

    def result(self) -> DataFrame:
        return self.rows.select(*self.columns)

    def carried(self, summary: dict[str, Column], carry: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
        """The rows with ``carry`` columns: each is made of the ``summary`` of a group's ranges in
        order, and null for groups that lie in one range."""
        whole = Window.partitionBy(*self.group)
        order = whole.orderBy("__range")
        per_range = self.rows.groupBy(*self.group, "__range").agg(*[c.alias(n) for n, c in summary.items()])
        made = per_range.withColumns({"__ranges": F.count("*").over(whole)}).where("__ranges > 1")
        for name, column in carry.items():
            made = made.withColumn(name, column(order))
        names = {g: f"__g{n}" for n, g in enumerate(self.group)}
        own = made.select(F.col("__range").alias("__r"), *[F.col(g).alias(n) for g, n in names.items()], *carry)
        same = F.col("__range") == F.col("__r")
        for g, n in names.items():
            same &= F.col(g).eqNullSafe(F.col(n))
        return self.rows.join(F.broadcast(own), same, "left").drop("__r", *names.values())

    def with_neighbours(self, value: Column, before: str | None, after: str | None) -> Placed:
        """Adds ``value`` of the rows before and after; null at the ends of a group."""
        boxed = self.with_columns({"__box": F.struct(value.alias("v"))})
        place = F.struct(*self.keys)
        rows = boxed.carried(
            {"__first": F.min_by("__box", place), "__last": F.max_by("__box", place)},
            {"__before": lambda w: F.lag("__last").over(w), "__after": lambda w: F.lead("__first").over(w)},
        )
        w, more = self.window(), {}
        if before:
            more[before] = F.coalesce(F.lag("__box").over(w), F.col("__before"))["v"]
        if after:
            more[after] = F.coalesce(F.lead("__box").over(w), F.col("__after"))["v"]
        made = rows.withColumns(more).drop("__box", "__before", "__after")
        return Placed(made, self.group, self.keys, [*self.columns, *[c for c in more if c not in self.columns]])

    def with_running_sum(self, value: Column, name: str) -> Placed:
        """Adds the sum of ``value`` up to and with each row."""
        valued = self.with_columns({"__v": value})
        rows = valued.carried({"__sum": F.sum("__v")}, {"__before": lambda w: F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1))})
        upto = F.sum("__v").over(self.window().rowsBetween(Window.unboundedPreceding, 0))
        made = rows.withColumn(name, upto + F.coalesce(F.col("__before"), F.lit(0))).drop("__v", "__before")
        return Placed(made, self.group, self.keys, [*self.columns, *([name] if name not in self.columns else [])])

    def with_chain(self, arrival: Column, cost: Column, name: str) -> Placed:
        """Adds the start of each row of a chain: start = max(arrival, start before + cost before).

        With S the costs of the rows before, start - S is the greatest arrival - S so far; a
        range hands on its costs and its greatest arrival - S, and two ranges compose to the
        sum of the costs and the greater of both, the second lowered by the first's costs.
        """
        valued = self.with_columns({"__a": arrival, "__cost": cost})
        w = self.window()
        spent = F.coalesce(F.sum("__cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        valued = valued.with_columns({"__spent": spent})
        valued = valued.with_columns({"__slack": F.col("__a") - F.col("__spent")})
        before = lambda o: o.rowsBetween(Window.unboundedPreceding, -1)
        rows = valued.carried(
            {"__costs": F.sum("__cost"), "__most": F.max("__slack")},
            {
                "__gone": lambda o: F.coalesce(F.sum("__costs").over(before(o)), F.lit(0)),
                "__best": lambda o: F.max(F.col("__most") - F.col("__gone")).over(before(o)),
            },
        )
        gone = F.coalesce(F.col("__gone"), F.lit(0))
        own = F.max("__slack").over(w.rowsBetween(Window.unboundedPreceding, 0)) - gone
        made = rows.withColumn(name, F.greatest(own, F.col("__best")) + gone + F.col("__spent"))
        made = made.drop("__a", "__cost", "__spent", "__slack", "__gone", "__best")
        return Placed(made, self.group, self.keys, [*self.columns, *([name] if name not in self.columns else [])])


def placed(df: DataFrame, group: list[str], order: list[Column]) -> Placed:
    """Rows by ranges of (group, order); ``order`` should tell rows of a group apart, as rows that
    are equal in it come in no certain order. A null group is a group."""
    keys = [f"__o{n}" for n in range(len(order))]
    dealt = df.withColumns(dict(zip(keys, order, strict=True)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(dealt.repartitionByRange(parts, *group, *keys).withColumn("__range", F.spark_partition_id()))
    return Placed(rows, group, keys, df.columns)
