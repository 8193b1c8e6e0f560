"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A *unit* is a word without its punctuation (so ``i.d-iot`` is ``idiot``); a run of three
or more single letters makes one unit (``i d i o t``). The kernel of two units counts
common subsequences of three characters, gaps included: an occurrence that spans k
characters weighs DECAY**k, up to SPAN. Gapped and inserted characters therefore lower a
similarity instead of ending it. Units carry marks for begin and end; units of over
WINDOW characters are read in overlapping windows, all of them.

Landmarks are units that toxic and clean training documents tell apart. Nothing depends on
the order of rows: units and documents are sorted, and lots are drawn by keyed hashes. The Nystroem map
of a unit is its kernel row times the inverse root of the landmarks' kernel. As labels are
known for whole documents, the machine is trained on the units that witness them
(multiple-instance: the highest units of toxic documents, the highest and a random lot of
clean ones, some rounds). A trained machine is linear in the subsequence features, so it
is folded into one weight for each triple of characters and scores any unit at the same
cost however many landmarks there are. A document's score is a logistic function of its
highest unit scores and their number.

Training reads a bounded sample of labelled rows (``MAX_TOXIC``, ``MAX_CLEAN``, by keyed
hash); scoring reads every whole text.

Defined cases: null and empty texts have no units and get the score of a text without any
sign of toxicity; labels that contradict each other for one id count as toxic; with no
labels of one kind all scores are 0; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrow import give_back, with_column_of_text
from scriptorium.llm.sampling import labelled_sample
from scriptorium.session import table

THRESHOLD = 0.3
MAX_TOXIC, MAX_CLEAN = 1500, 3000
LANDMARKS = 160
DECAY, SPAN, WINDOW = 0.7, 6, 24
ROUNDS, FOLDS = 4, 4
#: The highest of W windows is lowered by so much times log(W), as the highest of many is high by chance.
MANY_WINDOWS = 0.1
#: Clean units drawn into every training of a machine.
MAX_LOT = 6000
#: Units whose score a task remembers at most.
CACHE_UNITS = 75_000

PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SPELLED = re.compile(rb"(?<!\S)[a-z](?: [a-z]){2,}(?!\S)")
LETTERS = 96
BEGIN, END_MARK = 94, 95
STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def units_of(text: bytes) -> list[bytes]:
    """The units of a UTF-8 text, in order."""
    plain = text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(None, PUNCTUATION)
    if SPELLED.search(plain):
        plain = SPELLED.sub(lambda m: m[0].replace(b" ", b""), plain)
    return plain.split()


def _codes(points: np.ndarray) -> np.ndarray:
    """Code points as letters of an alphabet of 1 to 93: a-z, the accented letters of Western
    Europe, and 2, 6, 8 and 9 have their own; the other digits are the letters they stand for
    in disguise (0 o, 1 i, 3 e, 4 a, 5 s, 7 t); the rest go by remainder."""
    out = (63 + points % 31).astype(np.int32)
    small, accented = (points >= 97) & (points <= 122), (points >= 223) & (points <= 255)
    out[small] = points[small] - 96
    out[accented] = points[accented] - 223 + 27
    for digit, code in zip("2689", range(60, 64), strict=True):
        out[points == ord(digit)] = code
    for digit, letter in zip("013457", "oieast", strict=True):
        out[points == ord(digit)] = ord(letter) - 96
    return out


def _windows(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Coded windows (rows of WINDOW + 2, zero beyond the end) and the unit each belongs to."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = _codes(points)
    half = WINDOW // 2
    n_win = np.maximum(1, -(-(lengths - half) // half))
    owner = np.repeat(np.arange(len(units)), n_win)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    starts = (np.cumsum(lengths) - lengths)[owner] + nth * half
    have = np.minimum(lengths[owner] - nth * half, WINDOW)
    width = int(have.max(initial=0)) + 2
    place = np.arange(width)[None, :] - 1
    inside = (place >= 0) & (place < have[:, None])
    out = np.zeros((len(owner), width), dtype=np.int32)
    out[inside] = codes[(starts[:, None] + place)[inside]]
    out[:, 0] = BEGIN
    out[np.arange(len(owner)), have + 1] = END_MARK
    return out, owner


def _norms(sizes: np.ndarray) -> np.ndarray:
    """Length of the feature vector of a unit of so many characters, marks included, no triple repeated."""
    total = np.zeros(len(sizes))
    for a, b in STEPS:
        total += np.maximum(0, sizes - a - b) * DECAY ** (2 * (a + b + 1))
    return np.sqrt(np.maximum(total, DECAY**6))


def _triples(coded: np.ndarray):
    """(index of triple, weight) for each step, over all rows; index 0 has a place beyond the end."""
    for a, b in STEPS:
        n = coded.shape[1] - a - b
        if n > 0:
            first, second, third = coded[:, :n], coded[:, a : a + n], coded[:, a + b : a + b + n]
            yield np.where(third > 0, (first * LETTERS + second) * LETTERS + third, 0), DECAY ** (a + b + 1)


def features(units: list[str]) -> list[dict[int, float]]:
    """Normalised subsequence features of units, of up to WINDOW characters each."""
    coded, owner = _windows(units)
    norms = _norms((coded > 0).sum(1))
    out: list[dict[int, float]] = [{} for _ in units]
    for index, weight in _triples(coded):
        for row, own, norm in zip(index.tolist(), owner.tolist(), norms.tolist(), strict=True):
            bag = out[own]
            for t in row:
                if t:
                    bag[t] = bag.get(t, 0.0) + weight / norm
    return out


def fold(bags: list[dict[int, float]], weights: np.ndarray) -> np.ndarray:
    """Triple weights of a weighted sum of landmarks."""
    out = np.zeros(LETTERS**3)
    for bag, w in zip(bags, weights, strict=True):
        for t, x in bag.items():
            out[t] += w * x
    return out


def unit_scores(units: list[str], triple_weights: np.ndarray) -> np.ndarray:
    """Machine output of each unit: triple weights summed over its subsequences, normalised;
    for a long unit the highest of its windows. Columns if the weights have some."""
    flat = triple_weights.reshape(LETTERS**3, -1)
    out = np.full((len(units), flat.shape[1]), -np.inf)
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    for at in range(0, len(order), 4096):
        some = order[at : at + 4096]
        coded, owner = _windows([units[i] for i in some])
        total = np.zeros((len(owner), flat.shape[1]))
        for index, weight in _triples(coded):
            total += weight * (flat[:, 0][index].sum(1)[:, None] if flat.shape[1] == 1 else flat[index].sum(1))
        total /= _norms((coded > 0).sum(1))[:, None]
        np.maximum.at(out, np.asarray(some)[owner], total)
        out[some] -= MANY_WINDOWS * np.log(np.bincount(owner, minlength=len(some)))[:, None]
    return out if triple_weights.ndim > 1 else out[:, 0]


@dataclass
class Model:
    triples: np.ndarray
    bias: float
    weights: np.ndarray
    offset: float


def document_features(scores: np.ndarray) -> np.ndarray:
    """Of a document's unit scores: the three highest, log of the number above 0, log of all."""
    top = np.full(3, -2.0)
    if len(scores):
        best = np.sort(scores[np.argpartition(scores, -3)[-3:]] if len(scores) > 3 else scores)[::-1]
        top[: len(best)] = best
    top = np.clip(top, -2, 2)
    above = float((scores > 0).sum())
    return np.array([top[0], top[1], top[2], np.log1p(above), np.log1p(above) - np.log1p(len(scores))])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine by Newton steps on its active rows, some rows at a time."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(len(w))
        for at in range(0, len(x), 4096):
            some = slice(at, at + 4096)
            z = np.hstack([x[some].astype(np.float64), np.ones((len(x[some]), 1))])
            active = y[some] * (z @ w) < 1
            za = z[active] * (c * weight[some][active])[:, None]
            left += za.T @ z[active]
            right += za.T @ y[some][active]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _draw(name: bytes, seed: int) -> int:
    """A number that seed and name decide, and nothing else."""
    return int.from_bytes(hashlib.blake2b(name, digest_size=8, key=bytes([seed])).digest(), "big")


def _bent(unit: str) -> str:
    """The unit with a drawn letter put inside, as a disguise would."""
    x = _draw(unit.encode("utf-8", "replace"), 4)
    at = 1 + x % max(1, len(unit) - 1)
    return unit[:at] + chr(97 + (x >> 16) % 26) + unit[at:]


def _excess(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """How far the labels of a unit's documents depart from chance, in deviations."""
    seen, rate = toxic + clean, (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)
    return (toxic - rate * seen) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1.0))


def _pick_landmarks(names: list[bytes], toxic: np.ndarray, clean: np.ndarray) -> list[int]:
    """Units by how far their documents' labels depart from chance; then common and drawn ones."""
    excess = _excess(toxic, clean)
    strong = np.argsort(-excess, kind="stable")
    strong = [int(i) for i in strong[: LANDMARKS // 2] if excess[i] > 1.5]
    common = [int(i) for i in np.argsort(-clean, kind="stable")[: LANDMARKS // 8]]
    against = [int(i) for i in np.argsort(excess, kind="stable")[: LANDMARKS // 8]]
    chance = sorted(range(len(names)), key=lambda i: _draw(names[i], 1))[: LANDMARKS // 4]
    return list(dict.fromkeys(strong + common + against + chance))


def fit(docs: list[tuple[bytes, int]]) -> Model:
    """The machine of labelled documents (UTF-8 text, 1 if toxic), whatever their order.

    The machine is trained without one of FOLDS folds of the documents, and the logistic
    function is fitted on that fold, which the machine has not seen, as written and with a
    letter put into every longer unit; of the rounds, the one with the least loss is kept. Beside each unit that it
    is trained on, toxic or clean, stands the unit with a drawn letter put inside.
    """
    nothing = Model(np.zeros(LETTERS**3), -1.0, np.zeros(5), -30.0)
    docs = sorted(docs)
    labels = np.array([y for _, y in docs])
    if not len(docs) or labels.min() == labels.max():
        return nothing
    seen_units: set[bytes] = set()
    for text, _ in docs:  # texts are cut twice, as the units of all of them at once are many
        seen_units.update(units_of(text))
    raw = sorted(seen_units)
    if not raw:
        return nothing
    index = {u: n for n, u in enumerate(raw)}
    names = [u.decode("utf-8", "replace") for u in raw]
    del seen_units
    rows = [np.fromiter(map(index.__getitem__, units_of(t)), np.int32) for t, _ in docs]
    own = [np.unique(r) for r in rows]
    unseen = np.array([_draw(t, 2) % FOLDS == 0 for t, _ in docs])
    if any(len(set(labels[part].tolist())) < 2 for part in (unseen, ~unseen)):
        unseen = np.zeros(len(docs), dtype=bool)  # too few documents to keep some apart
    clean, toxic = np.zeros(len(names)), np.zeros(len(names))  # documents that hold a unit
    for r, y in ((r, y) for r, y, out in zip(own, labels, unseen, strict=True) if not out):
        (toxic if y else clean)[r] += 1
    marks = _pick_landmarks(raw, toxic, clean)
    bags = features([names[i] for i in marks])
    space = {t: n for n, t in enumerate(sorted(set().union(*bags)))}  # the landmarks' triples
    rows_of = np.zeros((len(marks), len(space)))
    for k, bag in enumerate(bags):
        rows_of[k, [space[t] for t in bag]] = list(bag.values())
    gram = rows_of @ rows_of.T
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # the Nystroem map is k(unit, landmarks) @ root
    lot = np.array(sorted(np.flatnonzero(clean).tolist(), key=lambda i: _draw(raw[i], 3))[:MAX_LOT], dtype=np.int64)
    now = _excess(toxic, clean)  # first witnesses by association
    known: dict[str, np.ndarray] = {}

    def mapped(units: list[str]) -> np.ndarray:
        new = sorted(set(units).difference(known))
        known.update(zip(new, (unit_kernel(new, rows_of, space) @ root).astype(np.float32), strict=True))
        out = np.empty((len(units), root.shape[1]), dtype=np.float32)
        for n, u in enumerate(units):
            out[n] = known[u]
        return out

    seen = [(r, y) for r, y, out in zip(own, labels, unseen, strict=True) if len(r) and not out]
    judged = unseen if unseen.any() else ~unseen
    bent = {u: _bent(u) if len(u) > 3 else u for u in sorted({names[i] for r, j in zip(own, judged, strict=True) if j for i in r})}
    more = sorted(set(bent.values()).difference(names))  # units of that fold as a disguise leaves them
    place = {u: n for n, u in enumerate([*names, *more])}
    as_bent = [np.array([place[bent[names[i]]] for i in r], dtype=np.int64) for r, j in zip(rows, judged, strict=True) if j]
    to_judge = [r for r, j in zip(rows, judged, strict=True) if j] + as_bent
    y_judged, least, model = np.tile(labels[judged].astype(float), 2), np.inf, nothing
    for _ in range(ROUNDS):
        best = lambda label, n: [names[i] for r, y in seen if y == label for i in r[np.argsort(-now[r], kind="stable")[:n]]]  # noqa: B023, E731
        pos, hard = best(1, 2), best(0, 3)
        if not pos or not hard:
            return nothing
        pos += [_bent(u) for u in pos]
        neg = [*hard, *map(_bent, hard), *[names[i] for i in lot]]
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[np.full(len(pos), 1.0 / len(pos)), np.full(len(neg), 1.0 / len(neg))] * 1000
        w, bias = _svm(mapped(pos + neg), y, weight)
        triples = fold(bags, root @ w)
        now = unit_scores([*names, *more], triples) + bias
        x = np.array([document_features(now[r]) for r in to_judge])
        weights, offset = _logistic(x, y_judged)
        loss = np.logaddexp(0, np.where(y_judged > 0, -1, 1) * (x @ weights + offset)).mean()
        if loss < least:
            least, model = loss, Model(triples, bias, weights, offset)
    return model


def unit_kernel(units: list[str], landmark_rows: np.ndarray, space: dict[int, int]) -> np.ndarray:
    """Kernel of units and landmarks, (units, landmarks); ``space`` numbers the landmarks' triples."""
    out = np.zeros((len(units), len(landmark_rows)))
    for at in range(0, len(units), 2000):
        for k, bag in enumerate(features(units[at : at + 2000]), at):
            shared = [(space[t], x) for t, x in bag.items() if t in space]
            if shared:
                places, values = zip(*shared, strict=True)
                out[k] = landmark_rows[:, list(places)] @ np.array(values)
    return out


class Scorer:
    """Scores documents with a model, remembering the scores of units seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, float] = {}

    def __call__(self, docs: list[bytes]) -> np.ndarray:
        split = [units_of(d) for d in docs]
        out = np.zeros(len(docs))
        at = 0
        while at < len(docs):  # as many documents as the memory for units allows
            new, end = set(), at
            while end < len(docs) and (end == at or len(new) < CACHE_UNITS):
                new.update(u for u in split[end] if u not in self.known)
                end += 1
            if len(self.known) + len(new) > 2 * CACHE_UNITS:
                self.known.clear()
                new = set().union(*split[at:end])
            names = list(new)
            scores = unit_scores([n.decode("utf-8", "replace") for n in names], self.model.triples) + self.model.bias
            self.known.update(zip(names, scores.tolist(), strict=True))
            for i in range(at, end):
                values = np.fromiter(map(self.known.__getitem__, split[i]), np.float64, len(split[i]))
                out[i] = document_features(values) @ self.model.weights + self.model.offset
            at = end
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of ``documents(doc_id, text)`` that ``labels(doc_id, toxic)`` knows."""
    rows = labelled_sample(documents, labels, "toxic", {1: MAX_TOXIC, 0: MAX_CLEAN}).collect()  # bounded by the two limits
    docs = [((r["text"] or "").encode(), r["label"]) for r in rows]
    del rows
    give_back()
    model = fit(docs)
    give_back()
    return model


def with_score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents(text, ...)`` and the score of each text as ``name``; a column that has that
    name already is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # LETTERS**3 weights, 2 MB
    scorers: list[Scorer] = []

    def step(own: list[bytes]) -> np.ndarray:
        if not scorers:
            scorers.append(Scorer(shared.value))
        return scorers[0](own)

    return with_column_of_text(documents.drop(name), name, T.DoubleType(), step)


def held_out(remainder: int, folds: int):
    """True where crc32 of the id as text leaves ``remainder``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == remainder, F.lit(False))


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of rows with remainder 2 of 4 are never read."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(2, 4))
    scored = with_score(documents, train(documents, labels))
    return scored.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
