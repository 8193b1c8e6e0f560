"""Divergence of sources by inclusion-exclusion over the supports of their terms.

Each group (lang, source) gives each kept term of its language a smoothed price of its
count; the distance of two groups is the sum of |p - q| over all kept terms, and most terms
occur in few groups. The sum is therefore taken apart:

* terms that a group has, as if the other had none of them: the group's histogram of prices
  against the other's price of nothing, all others at once by running sums over the
  histogram;
* terms that both have: the postings of a term joined with one another correct the two
  one-sided terms by what the pair really differs;
* terms that neither has: their number, which the supports and the overlap give, times the
  difference of the two prices of nothing.

Counting reads whole texts in Arrow batches and adds up counts of (lang, source, term) in
each task before anything is shuffled, so a hot source arrives as one row for each term and
task. All prices and sums are whole numbers.

Defined cases: null text, lang and source are empty strings; a text without terms makes its
group occur all the same; repeated rows count as often as they occur; a language without
kept terms has distance 0 between all its sources and no terms; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.arrow import pieces, texts
from scriptorium.session import cut, table

MIN_DOCS = 30
TOP_TERMS = 50
SCALE, SMOOTH = 1_000_000_000, 5
#: A task hands its counts on when it holds so many terms.
HELD_TERMS = 200_000
#: Rows of a batch that a task hands on.
OUT_ROWS = 20_000

#: Bytes that are in no term, after A-Z are lower-cased, as blanks.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, count long, docs long"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.lower().translate(_LETTERS).split()


def _flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for (lang, source), (counts, docs) in held.items():
        rows.append((lang, source, None, 0, 0))
        for term, n in counts.items():
            rows.append((lang, source, term.decode("utf-8", "replace"), n, docs[term]))
            if len(rows) >= OUT_ROWS:
                yield made()
                rows = []
    if rows:
        yield made()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for piece in pieces(batches):
        for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), texts(piece), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, found = len(counts), terms(text)
            counts.update(found)
            docs.update(set(found))
            size += len(counts) - before
        if size > HELD_TERMS:
            yield from _flushed(held)
            held, size = {}, 0
    yield from _flushed(held)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs); each group has a row with a null term besides."""
    plain = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)); 0 where no term is kept."""
    wide = lambda c: c.cast("decimal(18,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTH).cast("decimal(1,0)"))
    below = wide(total) + F.lit(SMOOTH).cast("decimal(1,0)") * wide(kept)
    # Whole quotient of decimals: the remainder is taken off first, so that the division is exact.
    exact = ((above - above % below) / below).cast("long")
    return F.when(kept > 0, exact + 1).otherwise(F.lit(0).cast("long"))


def _priced(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of kept terms and groups, both with their prices.

    Most terms are rare: only those kept are written, with one row for each group besides.
    """
    sources = Window.partitionBy("lang", "term")  # a row for each source at most
    summed = counts.withColumns({"lang_docs": F.sum("docs").over(sources), "lang_count": F.sum("count").over(sources)})
    counts = cut(summed.where((F.col("lang_docs") >= MIN_DOCS) | F.col("term").isNull()).drop("docs", "lang_docs"))
    postings = counts.where("term is not null")
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    of_lang = postings.groupBy("lang", "term").agg(F.max("lang_count").alias("c")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("c").alias("lang_total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = cut(groups.withColumn("nothing", price(F.lit(0), F.col("total"), F.col("kept"))))
    priced = postings.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "nothing",
        price(F.col("count"), F.col("total"), F.col("kept")).alias("p"),
        price(F.col("lang_count"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    return cut(priced), groups


def _one_sided(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, one, support, nothing, kept): sum over the source's terms of
    |its price - the other's price of nothing|, for every other source of the language.

    One running sum over a group's histogram answers all others: a window holds one row for
    each distinct price of the group and one for each other source.
    """
    histogram = postings.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("n")).withColumn("other", F.lit(None).cast("string"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("nothing").alias("at"))
    asked = groups.select("lang", "source").join(others, "lang").where("source <> other").withColumn("n", F.lit(0).cast("long"))
    rows = histogram.unionByName(asked)
    whole = Window.partitionBy("lang", "source")
    below = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("n") * F.col("at")
    summed = rows.withColumns({"nb": F.sum("n").over(below), "mb": F.sum(mass).over(below), "support": F.sum("n").over(whole), "mass": F.sum(mass).over(whole)})
    one = F.col("at") * F.col("nb") - F.col("mb") + (F.col("mass") - F.col("mb")) - F.col("at") * (F.col("support") - F.col("nb"))
    own = groups.select("lang", "source", "nothing", "kept")
    return summed.where("other is not null").select("lang", "source", "other", one.alias("one"), "support").join(own, ["lang", "source"])


def _overlaps(postings: DataFrame) -> DataFrame:
    """(lang, first, second, correction, both) of sources that share terms, first < second."""
    side = lambda n: postings.select("lang", "term", F.col("source").alias(n), F.col("p").alias(f"p_{n}"), F.col("nothing").alias(f"z_{n}"))
    met = side("first").join(side("second"), ["lang", "term"]).where("first < second")
    real = F.abs(F.col("p_first") - F.col("p_second"))
    priced = F.abs(F.col("p_first") - F.col("z_second")) + F.abs(F.col("p_second") - F.col("z_first"))
    return met.groupBy("lang", "first", "second").agg(F.sum(real - priced).alias("correction"), F.count("*").alias("both"))


def pair_distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two different sources of a language, both ways."""
    names = [F.least("source", "other").alias("first"), F.greatest("source", "other").alias("second")]
    one = _one_sided(postings, groups).groupBy("lang", *names).agg(
        F.sum("one").alias("one"), F.sum("support").alias("support"), F.max("kept").alias("kept"), (F.max("nothing") - F.min("nothing")).alias("apart")
    )
    found = one.join(_overlaps(postings), ["lang", "first", "second"], "left").na.fill(0, ["correction", "both"])
    neither = F.col("kept") - F.col("support") + F.col("both")
    value = (F.col("one") + F.col("correction") + neither * F.col("apart")).alias("value")
    ways = F.explode(F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("first", "second"), ("second", "first"))]))
    return found.select("lang", value, ways.alias("way")).select("lang", "way.source", "way.item", "value")


def audit(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``documents(text, lang, source)``."""
    postings, groups = _priced(term_counts(documents))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    pairs = ranked(pair_distances(postings, groups)).withColumn("part", F.lit("pair"))
    over = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = ranked(over).where(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionAll(top.select(columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language, and the terms that each has more than its language."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents
), words AS (
  SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d
), lowered AS (
  SELECT lang, source, r, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words
), kept AS (
  SELECT lang, term, count(*) AS lc FROM lowered GROUP BY ALL HAVING count(DISTINCT r) >= 30
), have AS (
  SELECT lang, source, term, count(*) AS c FROM lowered SEMI JOIN kept USING (lang, term) GROUP BY ALL
), ends AS (
  SELECT lang, count(*) AS v, sum(lc) AS ln FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(any_value(n), 0) AS n, coalesce(any_value(v), 0) AS v, coalesce(any_value(ln), 0) AS ln
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM have GROUP BY ALL) USING (lang, source)
  LEFT JOIN ends USING (lang) GROUP BY ALL
), prices AS (
  SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(h.c, 0) + 5)) // (g.n + 5 * g.v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.lc + 5)) // (g.ln + 5 * g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN have h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), over AS (
  SELECT lang, source, term AS item, p - q AS value FROM prices WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM over
) WHERE rank <= 50
"""
