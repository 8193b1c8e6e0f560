"""Exact top-k search by segment means and deviations, coarse to fine.

Components x are the whole numbers floor(256 * x), and the score is their inner product.
For a segment of L components with mean m and deviation s, the squared distance of two
vectors is at least the sum over segments of L * ((m - m')^2 + (s - s')^2); as
2 * score = |q|^2 + |x|^2 - distance^2, the score is at most the sum of L * (m m' + s s').
Segments of half the length give a closer bound. A block of rows is bounded by its longest
segments first, what still may reach a query's k-th best score goes on to shorter ones,
and only survivors are scored. Pruning loses nothing: bounds are taken with a margin above
the rounding of doubles, and rows whose bound equals the k-th best score stay.

The stated query set is searched in slabs of QUERY_BYTES at most, which are broadcast; each
slab scans all rows once where they lie, without a shuffle, and a task returns k rows a
query at most. Before that, a bounded lot of rows is scored for the slab, so that every
task starts with a k-th best score that is reached already.

Scores are exact: products of doubles are used where norms show that all sums stay below
2**52, whole numbers of Python elsewhere. A score beyond a long counts as the nearest long.

Defined cases: rows without id, null vectors and vectors with a null or non-finite
component (or one whose 256-fold is not finite) take no part; of vectors of different
lengths, what the shorter one lacks counts as 0; rows that repeat an id are rows of their
own, and a row is no candidate of itself alone; equal scores go to the smaller id; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators.ranking import rank_in_groups
from scriptorium.session import cut, table

UNIT = 256.0
#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 32 << 20
#: Rows scored for a slab before its scan.
SEED_ROWS = 2048
#: Rows and queries that are bounded at once.
ROWS, QUERIES = 4096, 256
#: Segments of so many components, coarse to fine.
LENGTHS = (32, 16, 8)
#: Whole sums of doubles are exact below this.
EXACT = float(1 << 52)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Share of pairs above which a full product is cheaper than picking pairs out.
DENSE = 0.1

FOUND = "query_row long, query_id long, vec_id long, row_no long, score long"


def whole(vectors: pa.ListArray, width: int) -> np.ndarray:
    """floor(UNIT * x) of each component, as doubles, with zeros behind short vectors."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width))
    inside = np.arange(width)[None, :] < sizes[:, None]
    out[inside] = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * UNIT)


def segments(x: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of a vector's segments, so scaled that the product of two such
    rows is the bound of the vectors' product."""
    pad = -x.shape[1] % length
    cells = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, length)
    mean = cells.mean(2)
    return np.hstack([mean, cells.std(2)]) * np.sqrt(length)


@dataclass
class Slab:
    """Queries of a slab: row numbers, ids, vectors, and the score that each reaches already."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    reached: np.ndarray

    def __post_init__(self) -> None:
        self.norms = np.sqrt((self.vectors**2).sum(1))
        self.levels: list[np.ndarray] | None = None

    def level(self, n: int) -> np.ndarray:
        if self.levels is None:
            self.levels = [segments(self.vectors, length) for length in LENGTHS]
        return self.levels[n]


class Best:
    """The k best of each query so far, by score and smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query = np.zeros(0, dtype=np.int64)
        self.id, self.row, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(n, LONG_MIN, dtype=np.int64)  # of a full list

    def add(self, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        q, i, r, s = (np.concatenate(x) for x in zip((self.query, self.id, self.row, self.score), (query, ids, rows, scores), strict=True))
        order = np.lexsort((r, i, ~s, q))  # ~s falls as s rises, and never overflows
        q = q[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        order = order[keep]
        self.query, self.id, self.row, self.score = q[keep], i[order], r[order], s[order]
        ends = np.flatnonzero(np.arange(len(self.query)) - np.searchsorted(self.query, self.query) == self.k - 1)
        self.least[self.query[ends]] = self.score[ends]


def _wide_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products by whole numbers of Python, held to the range of a long."""
    left = [[int(v) for v in q] for q in queries]
    right = [[int(v) for v in x] for x in vectors]
    return np.array([[min(LONG_MAX, max(LONG_MIN, sum(a * b for a, b in zip(q, x, strict=True)))) for x in right] for q in left], dtype=np.int64).reshape(len(left), len(right))


def search_block(slab: Slab, best: Best, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> int:
    """Adds what a block of rows has for the slab's queries to ``best``; returns how many pairs were scored."""
    scored = 0
    norms = np.sqrt((x**2).sum(1))
    small = norms * slab.norms.max(initial=0) < EXACT
    for at in np.flatnonzero(~small):  # rows of huge components, one by one
        got = _wide_scores(slab.vectors, x[at : at + 1])[:, 0]
        mine = np.flatnonzero((slab.rows != rows[at]) & (got >= np.maximum(slab.reached, best.least)))
        best.add(mine, np.full(len(mine), ids[at]), np.full(len(mine), rows[at]), got[mine])
        scored += len(slab.rows)
    ids, rows, x, norms = ids[small], rows[small], x[small], norms[small]
    if not len(ids):
        return scored
    levels = [segments(x, length) for length in LENGTHS]
    for begin in range(0, len(slab.rows), QUERIES):
        some = slice(begin, begin + QUERIES)
        vectors = slab.vectors[some]
        need = np.maximum(slab.reached[some], best.least[some]).astype(np.float64)
        margin = 1e-9 * slab.norms[some]
        # The coarsest level bounds all pairs, the others what is left of them.
        bound = slab.level(0)[some] @ levels[0].T
        bound += margin[:, None] * norms[None, :] + 1e-3
        q, c = np.nonzero(bound >= need[:, None])
        del bound
        for n in range(1, len(LENGTHS)):
            if len(q) > DENSE * len(vectors) * len(x):
                finer = (slab.level(n)[some] @ levels[n].T)[q, c]
            else:
                finer = np.einsum("ij,ij->i", slab.level(n)[some][q], levels[n][c])
            stay = finer + margin[q] * norms[c] + 1e-3 >= need[q]
            q, c = q[stay], c[stay]
        scored += len(q)
        if len(q) > DENSE * len(vectors) * len(x):
            got = (vectors @ x.T)[q, c].astype(np.int64)
        else:
            got = np.einsum("ij,ij->i", vectors[q], x[c]).astype(np.int64)
        mine = (got >= np.maximum(slab.reached, best.least)[some][q]) & (slab.rows[some][q] != rows[c])
        if mine.any():
            best.add(q[mine] + begin, ids[c[mine]], rows[c[mine]], got[mine])
    return scored


def scan(vectors: DataFrame, slab: Slab, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, row_no, score): each task's k best rows of every query that
    reach what the query reaches already."""
    shared = vectors.sparkSession.sparkContext.broadcast(slab)  # QUERY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(len(own.rows), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = whole(part.column("v"), own.vectors.shape[1])
                search_block(own, best, *(part.column(c).to_numpy() for c in ("vec_id", "row_no")), x)
        for at in range(0, len(best.query), 20_000):
            piece = slice(at, at + 20_000)
            q = best.query[piece]
            arrays = [own.rows[q], own.ids[q], best.id[piece], best.row[piece], best.score[piece]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["query_row", "query_id", "vec_id", "row_no", "score"])

    return vectors.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors(vec_id, embedding)`` for
    each row where ``is_query`` holds."""
    big = F.lit(float(np.finfo(np.float64).max) / UNIT)
    sound = F.col("vec_id").isNotNull() & F.forall("v", lambda e: F.coalesce(F.abs(e) <= big, F.lit(False)) & ~F.isnan(e))
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = cut(typed.where(sound).withColumn("row_no", F.monotonically_increasing_id()))
    seen = rows.agg(F.sum(F.when(F.col("asks"), 1).otherwise(0)).alias("queries"), F.max(F.size("v")).alias("width")).first()
    n_queries, width = int(seen["queries"] or 0), max(1, int(seen["width"] or 0))
    per_slab = max(1, query_bytes // (8 * width))
    asked = rank_in_groups(rows.where("asks").select("row_no", "vec_id", "v", F.lit(0).alias("all")), ["all"], [F.col("row_no")], "nth")
    asked = cut(asked.withColumn("slab", F.floor((F.col("nth") - 1) / per_slab)))
    lot = cut(rows.orderBy(F.xxhash64(F.lit(3), "row_no")).limit(SEED_ROWS))
    candidates, parts = rows.select("row_no", "vec_id", "v"), []
    for n in range(-(-n_queries // per_slab)):
        own = asked.where(F.col("slab") == n).orderBy("nth").select("row_no", "vec_id", "v").toArrow().combine_chunks()  # query_bytes at most
        vectors_of = own.column("v").combine_chunks()
        slab = Slab(own.column("row_no").to_numpy(), own.column("vec_id").to_numpy(), whole(vectors_of, width), np.full(own.num_rows, LONG_MIN, dtype=np.int64))
        reached = _best(scan(lot.select("row_no", "vec_id", "v"), slab, k), k).where(F.col("rank") == k).select("query_row", "score").collect()  # one row a query
        at = {r["query_row"]: r["score"] for r in reached}
        slab.reached = np.array([at.get(r, LONG_MIN) for r in slab.rows.tolist()], dtype=np.int64)
        parts.append(cut(_best(scan(candidates, slab, k), k).select(F.col("query_id"), F.col("rank"), F.col("vec_id"), F.col("score"))))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionAll, parts)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of all embeddings for every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
