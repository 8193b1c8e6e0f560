"""Quality by positive-unlabelled learning with a non-negative risk estimate.

Only trusted positives (quality 1) and unlabelled web text are learnt from; negative
labels are not read. A small network is trained to minimise

    prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0))

with the logistic loss; where the second term would fall below zero, that batch's step
climbs it back instead. The class prior comes from a first classifier of positives against
unlabelled text: among its highest scores, where no negative text is left, the share of
unlabelled text over the share of positives is the prior; the mean of the lower half of
such ratios over many thresholds is taken. Rows are halved by keyed hashes of their ids, a
first classifier is fitted on each half, and the shares of unlabelled text are counted over
all unlabelled rows, each by the classifier of the other half.

The features of a text are rates of kinds of characters, lengths and repetition of words
and lines, over the whole text. Networks are fitted on a bounded sample (``MAX_POSITIVE``,
``MAX_UNLABELLED`` rows, by keyed hash); the prior and the scores read every whole text.

Defined cases: null and empty texts have the features of no characters and no words;
without positives or without unlabelled rows every score is 0; repeated rows score alike;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrow import map_arrow, texts, with_column_of_text
from scriptorium.llm.sampling import hashed_lot
from scriptorium.session import table

THRESHOLD = 0.5
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
HIDDEN, STEPS, BATCH, STEP = 32, 3000, 500, 5e-3
#: The prior is the median of the estimates of both halves of so many random halvings.
HALVINGS = 3
#: Standardised features are cut at so many deviations.
CLIP = 5.0
#: Bytes of each class, by ASCII; bytes beyond are letters of other scripts.
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" ",
    b"\n",
    b".,;:'\"?-()",
    b"!",
    b"|",
    b"#$%&*",
    b"<>{}[]=/\\_~^`@+",
    bytes(range(128, 256)),
]
N_FEATURES = len(CLASSES) + 11


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES):
        out[list(members), k] = 1
    return out


_MATRIX = _class_matrix()


def text_features(text: bytes) -> np.ndarray:
    """Rates and repetition of one UTF-8 text."""
    size = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    rates = counts @ _MATRIX / max(1, size)
    words = text.split()
    n = len(words)
    low = text.lower().split()
    distinct = len(set(low))
    again = sum(map(eq, low, low[1:]))
    alternate = sum(map(eq, low, low[2:]))
    lines = [x for x in text.split(b"\n") if x]
    repeated = len(lines) - len(set(lines))
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    p = counts[counts > 0] / max(1, size)
    more = [
        np.log1p(size) / 10,
        np.log1p(n) / 10,
        np.log((distinct + 1) / (n + 1) ** 0.8),
        again / max(1, n - 1),
        alternate / max(1, n - 2),
        repeated / max(1, len(lines)),
        lengths.mean() / 10,
        lengths.std() / 10,
        np.log1p(size / max(1, len(lines))) / 10,
        -(p * np.log(p)).sum() / 5 if size else 0.0,
        float(size == 0),
    ]
    return np.concatenate([np.sqrt(rates), more])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def output(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x), -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int = 3) -> Model:
    """The network for a prior; without one, a plain classifier of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.vstack([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    norm = lambda x: np.clip((x - mean) / scale, -CLIP, CLIP)
    zp, zu = norm(pos), norm(unl)
    params = [rng.normal(0, 1 / np.sqrt(zp.shape[1]), (zp.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = max(1, min(200, -(-len(zu) // BATCH)))
    for _ in range(-(-STEPS // steps)):
        order_u, order_p = rng.permutation(len(zu)), rng.permutation(len(zp))
        for part_u, part_p in zip(np.array_split(order_u, steps), np.array_split(order_p, steps), strict=True):
            if not len(part_u) or not len(part_p):
                part_u, part_p = order_u[:BATCH], order_p[:BATCH]
            x = np.vstack([zp[part_p], zu[part_u]])
            n_p, n_u = len(part_p), len(part_u)
            h = np.maximum(x @ params[0] + params[1], 0)
            f = h @ params[2] + params[3][0]
            up, uu = _sigmoid(f[:n_p]), _sigmoid(f[n_p:])  # slopes of the loss as 0; as 1 they are these less 1
            if prior is None:
                g = np.concatenate([(up - 1) / n_p, uu / n_u])
            else:
                loss0 = lambda v: np.logaddexp(0, v).mean()
                negative = loss0(f[n_p:]) - prior * loss0(f[:n_p])
                rest = np.concatenate([-prior * up / n_p, uu / n_u])
                g = np.concatenate([prior * (up - 1) / n_p, np.zeros(n_u)]) + rest if negative >= 0 else -rest
            back = g[:, None] * params[2][None, :] * (h > 0)
            grads = [x.T @ back + 1e-4 * params[0], back.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            t += 1
            for p, gr, a, b in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (gr - a)
                b += 0.001 * (gr * gr - b)
                p -= STEP * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior or 0.0)


@dataclass
class First:
    """A first classifier of one half: thresholds, and the shares of the other half's positives that reach them."""

    halving: int
    half: int
    model: Model
    at: np.ndarray
    positive: np.ndarray


def prior_of(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from the shares of both that reach the thresholds."""
    ratios = np.sort(unlabelled / positive)
    return float(np.clip(ratios[: len(ratios) // 2].mean(), 0.02, 0.98))


def first_classifiers(x: np.ndarray, is_p: np.ndarray, is_u: np.ndarray, halves: np.ndarray) -> list[First]:
    """Of rows that are positives, unlabelled, or both; ``halves[row, halving]`` is 0 or 1."""
    out = []
    for h in range(halves.shape[1]):
        for k in (0, 1):
            mine, rest = halves[:, h] == k, halves[:, h] != k
            if (mine & is_p).any() and (mine & is_u).any() and (rest & is_p).any():
                model = _train(x[mine & is_p], x[mine & is_u], None)
                scores = model.output(x[rest & is_p])
                at = np.quantile(scores, np.linspace(0.02, 0.5, 49))
                out.append(First(h, k, model, at, (scores[:, None] >= at).mean(0)))
    return out


def reached(firsts: list[First], x: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """For each first classifier: how many rows of the other half reach each of its thresholds, and, last, their number."""
    out = np.zeros((len(firsts), 50), dtype=np.int64)
    for n, first in enumerate(firsts):
        scores = np.sort(first.model.output(x[halves[:, first.halving] != first.half]))
        out[n] = [*(len(scores) - np.searchsorted(scores, first.at)), len(scores)]
    return out


def fit(x: np.ndarray, is_p: np.ndarray, is_u: np.ndarray, halves: np.ndarray | None = None, count=None) -> Model:
    """From features of rows that are positives, unlabelled, or both (a positive's text in
    the unlabelled lot). ``count`` gives ``reached`` over all unlabelled rows; without it,
    the rows at hand are all."""
    if not is_p.any() or not is_u.any():
        zero = np.zeros(N_FEATURES)
        return Model(zero, zero + 1, np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), -30.0, 0.0)
    if halves is None:
        rng = np.random.default_rng(7)
        halves = np.stack([rng.permutation(len(x)) % 2 for _ in range(HALVINGS)], axis=1)
    firsts = first_classifiers(x, is_p, is_u, halves)
    counts = count(firsts) if count and firsts else reached(firsts, x[is_u], halves[is_u])
    priors = [prior_of(c[:-1] / c[-1], f.positive) for c, f in zip(counts, firsts, strict=True) if c[-1]]
    return _train(x[is_p], x[is_u], float(np.median(priors)) if priors else 0.5)


def _halves() -> Column:
    """Bits of the halvings of a row, by its id."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(100 + h), "doc_id"), F.lit(2)).cast("int") for h in range(HALVINGS)])


def reached_by_all(web: DataFrame, firsts: list[First]) -> np.ndarray:
    """``reached`` over all rows of ``web(doc_id, text)``, added up by Spark."""
    shared = web.sparkSession.sparkContext.broadcast(firsts)  # 2 * HALVINGS small networks

    def step(batch: pa.RecordBatch) -> dict:
        x = np.array([text_features(t) for t in texts(batch)]).reshape(-1, N_FEATURES)
        halves = np.array(batch.column("halves").to_pylist(), dtype=int).reshape(-1, HALVINGS)
        found = reached(shared.value, x, halves)
        return {"n": list(range(len(found))), "counts": found.tolist()}

    rows = map_arrow(web.select("text", _halves().alias("halves")), "n int, counts array<long>", step)
    summed = rows.groupBy("n").agg(F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(50)]).alias("counts")).collect()  # a row for each network
    out = np.zeros((len(firsts), 50), dtype=np.int64)
    for r in summed:
        out[r["n"]] = r["counts"]
    return out


def features(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text)`` as (doc_id, x)."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "x": [text_features(t) for t in texts(batch)]}

    return map_arrow(documents.select("doc_id", "text"), "doc_id long, x array<double>", step)


def train(documents: DataFrame, labels: DataFrame, web: DataFrame) -> Model:
    """Positives: rows of ``labels(doc_id, quality)`` with quality 1; unlabelled text: ``web(doc_id, text)``."""
    positive = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null")
    marked = hashed_lot(positive, MAX_POSITIVE, 1).select("doc_id", F.lit(1).alias("is_p"))
    lot = hashed_lot(web.where("doc_id is not null").select("doc_id").distinct(), MAX_UNLABELLED, 2).select("doc_id", F.lit(1).alias("is_u"))
    chosen = marked.join(lot, "doc_id", "full")  # MAX_POSITIVE + MAX_UNLABELLED ids at most
    found = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = features(found.groupBy("doc_id").agg(F.min("text").alias("text"))).join(chosen, "doc_id").withColumn("halves", _halves()).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    is_p, is_u = (np.array([bool(r[c]) for r in rows], dtype=bool) for c in ("is_p", "is_u"))
    halves = np.array([r["halves"] for r in rows], dtype=int).reshape(-1, HALVINGS)
    return fit(x, is_p, is_u, halves, lambda firsts: reached_by_all(web, firsts))


def with_score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents(text, ...)`` and the score of each text as ``name``; a column that has that
    name already is replaced."""

    def step(own: list[bytes]) -> np.ndarray:
        return model.scores(np.array([text_features(t) for t in own]).reshape(-1, N_FEATURES))

    return with_column_of_text(documents.drop(name), name, T.DoubleType(), step)


def held_out(remainder: int, folds: int):
    """True where crc32 of the id as text leaves ``remainder``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == remainder, F.lit(False))


def op8_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; labels of rows with remainder 1 of 3 are never read."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(1, 3))
    scored = with_score(documents, train(documents, labels, documents.where(~held_out(1, 3))))
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
