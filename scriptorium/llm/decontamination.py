"""Benchmark decontamination by a BM25 index of test items with block-max pruning.

Every training text is cut into overlapping passages, and every passage is a query. An
item's BM25 score is divided by the score of the item's own text, so a passage that holds
all of an item scores 1 or more, and one threshold serves items of any length. Postings
are kept in blocks of BLOCK_ITEMS items with each term's highest impact in the block.
For a passage, terms are taken in order of their highest impact anywhere; those before the
pivot, whose highest impacts together stay below the threshold, are never walked. The
blocks of the terms from the pivot on are left at once if what these terms reach there and
all that the others could add stay below the threshold. For the blocks that remain the
others are walked or, if that is less, looked up, and a block is scored exactly only if its block maxima over the
passage's terms reach the threshold. No item that reaches the threshold is lost.

Retrieved items are verified on the whole text: an item's question (up to the last ``?``;
without one, all but its last sentence) and its answer (the rest) must each share at least
``overlap`` of their five-word shingles with the text. A part of fewer words counts as one
shingle; an empty part needs nothing. One changed word takes up to five shingles, which is
most of a part of up to 13 words. So parts are also compared in the passage by the widest
shingles of which any one changed word leaves half, near the words of the other part that
are found there; the higher share counts. A part of one word, of which a change leaves
nothing, must stand within the item's length of the longer part: a question is held with its
answer, and not without. Only items of one part of fewer than five words
must be held as they are.

Document frequencies, the number of items and their mean length are counted by Spark over
the whole benchmark, so scores do not depend on how the index is cut. It is cut by a hash of
the items into slices of about SLICE_WORDS words, which bounds what the driver and each task
hold; each further slice is a further pass, and its index is dropped before the next one.

Defined cases: null and empty texts have no passages; null and blank items are no items;
items of equal text are found together; repeated rows are judged alike; without items or
texts the result is empty; only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrow import fresh_name, map_arrow, texts, with_column_of_text
from scriptorium.session import cut, table

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.5, 5
BLOCK_ITEMS = 4
MIN_STRIDE = 64
SLICE_WORDS = 1_000_000
#: Cells of the table of passages and blocks that a task fills at once.
CELLS = 200_000
#: Rows that may be broadcast to flag documents; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
SPACES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII marks part them."""
    return text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(SPACES).split()


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    at = text.rstrip().rfind("?")
    if at >= 0 and text[at + 1 :].strip():
        return text[: at + 1], text[at + 1 :]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)|\n", text.strip())]
    body = text.strip()
    return (body[: ends[-1]], body[ends[-1] :]) if ends else (body, "")


def shingles(words: list[bytes], width: int = SHINGLE) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    if not width:
        return set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def steady_width(words: list[bytes]) -> int:
    """The widest shingles, of SHINGLE words at most, of which a change of any one word leaves
    half (``OVERLAP``); 0 if there are none."""
    for width in range(min(SHINGLE, len(words)), 0, -1):
        grams = list(zip(*(words[i:] for i in range(width)), strict=False))
        n = len(set(grams))
        if n - width >= OVERLAP * n:  # a word is in so many shingles at most
            return width
        if len(words) <= 4 * SHINGLE and all(len({*grams[: max(0, at - width + 1)], *grams[at + 1 :]}) >= OVERLAP * n for at in range(len(words))):
            return width
    return 0


def judged_parts(text: str) -> tuple[list[list[bytes]], tuple[bool, bool]]:
    """Words of an item's question and answer, and which of them is loose: so short that a changed
    word can wipe it out, beside one that is not."""
    parts = [words_of(p.encode()) for p in parts_of(text)]
    steady = [steady_width(p) > 0 for p in parts]
    loose = bool(parts[0] and not steady[0] and steady[1]), bool(parts[1] and not steady[1] and steady[0])
    return parts, loose


@dataclass
class Index:
    """BM25 impacts of a slice of items, as fractions of the items' own scores."""

    items: list[int]
    questions: list[set]
    answers: list[set]
    #: steady shingles of questions and answers, and the items' words
    steady: list[tuple[set, set]]
    #: whether question and answer are loose; their steady shingles are then all of their words
    loose: list[tuple[bool, bool]]
    sizes: list[int]
    vocabulary: dict[bytes, int]
    #: postings, by term: item and impact
    post_item: np.ndarray
    post_impact: np.ndarray
    #: blocks, by term: term and block as one number, highest impact, first posting (and an end)
    block_at: np.ndarray
    block_key: np.ndarray
    block_max: np.ndarray
    block_post: np.ndarray
    term_max: np.ndarray
    stride: int

    @property
    def n_blocks(self) -> int:
        return -(-len(self.items) // BLOCK_ITEMS)


@dataclass
class Statistics:
    """Of a whole benchmark: items, their mean length, and of the words at hand in how many items each is."""

    n_items: int
    mean_length: float
    frequency: dict[bytes, int]


def build_index(items: list[tuple[int, str]], of_all: Statistics | None = None) -> Index | None:
    """The index of (id, text) items, without blank ones, with the statistics of the whole
    benchmark (default: of these items)."""
    bags = [(i, t, Counter(words_of(t.encode()))) for i, t in items]
    bags = [x for x in bags if x[2]]
    if not bags:
        return None
    vocabulary: dict[bytes, int] = {}
    entries = [(vocabulary.setdefault(w, len(vocabulary)), n, tf) for n, (_, _, bag) in enumerate(bags) for w, tf in bag.items()]
    term, item, tf = (np.array(c) for c in zip(*entries, strict=True))
    lengths = np.array([sum(b.values()) for _, _, b in bags], dtype=float)
    if of_all is None:
        df, n_items, mean = np.bincount(term, minlength=len(vocabulary)), len(bags), lengths.mean()
    else:
        df, n_items, mean = np.array([of_all.frequency[w] for w in vocabulary]), of_all.n_items, of_all.mean_length
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
    impact = impact / np.bincount(item, impact)[item]
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    pair = term * -(-len(bags) // BLOCK_ITEMS) + item // BLOCK_ITEMS
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    block_max, block_term = np.maximum.reduceat(impact, start), term[start]
    block_at = np.searchsorted(block_term, np.arange(len(vocabulary) + 1))
    parts = [judged_parts(t) for _, t, _ in bags]
    return Index(
        [i for i, _, _ in bags],
        [shingles(q) for (q, _), _ in parts],
        [shingles(a) for (_, a), _ in parts],
        [tuple(shingles(p, SHINGLE if free else steady_width(p)) for p, free in zip(*both, strict=True)) for both in parts],
        [loose for _, loose in parts],
        lengths.astype(int).tolist(),
        vocabulary,
        item,
        impact,
        block_at,
        pair[start],
        block_max,
        np.r_[start, len(item)],
        np.maximum.reduceat(block_max, block_at[:-1]),
        max(MIN_STRIDE, int(lengths.max())),
    )


def _spread(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a ragged table that starts at ``at``: (position in ``which``, place in the table)."""
    sizes = at[which + 1] - at[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + at[which][owner]


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, n_passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) with score >= threshold, for distinct sorted (passage, term) pairs."""
    eps, n_blocks = 1e-9, index.n_blocks
    order = np.lexsort((index.term_max[term], passage))
    passage, term = passage[order], term[order]
    starts = np.searchsorted(passage, np.arange(n_passages + 1))
    running = np.cumsum(index.term_max[term])
    running -= np.r_[0.0, running][starts[passage]]
    essential = running >= threshold - eps  # from the pivot on
    others = np.bincount(passage[~essential], index.term_max[term[~essential]], minlength=n_passages)
    owner, place = _spread(index.block_at, term[essential])
    cells = n_passages * n_blocks
    bound = np.bincount(passage[essential][owner] * n_blocks + index.block_key[place] % n_blocks, index.block_max[place], minlength=cells)
    cell = np.flatnonzero((bound > 0) & (bound + np.repeat(others, n_blocks) >= threshold - eps))

    def held(cell: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell number, entry) of the terms of each cell's passage that its block holds."""
        owner, place = _spread(starts, cell // n_blocks)
        wanted = terms[place] * n_blocks + cell[owner] % n_blocks
        entry = np.minimum(np.searchsorted(index.block_key, wanted), len(index.block_key) - 1)
        hit = index.block_key[entry] == wanted
        return owner[hit], entry[hit]

    seen = np.zeros(n_passages, dtype=bool)
    seen[cell // n_blocks] = True
    rest = ~essential & seen[passage]
    rest_term, rest_starts = term[rest], np.searchsorted(passage[rest], np.arange(n_passages + 1))
    walked = (index.block_at[rest_term + 1] - index.block_at[rest_term]).sum()
    if walked > np.diff(rest_starts)[cell // n_blocks].sum():  # looking up is less than walking
        owner, entry = held(cell, rest_term, rest_starts)
        bound += np.bincount(cell[owner], index.block_max[entry], minlength=cells)
    else:
        owner, place = _spread(index.block_at, rest_term)
        bound += np.bincount(passage[rest][owner] * n_blocks + index.block_key[place] % n_blocks, index.block_max[place], minlength=cells)
    cell = cell[bound[cell] >= threshold - eps]
    owner, entry = held(cell, term, starts)
    of, post = _spread(index.block_post, entry)
    key, back = np.unique(cell[owner][of] // n_blocks * len(index.items) + index.post_item[post], return_inverse=True)
    score = np.bincount(back, index.post_impact[post], minlength=len(key))
    good = score >= threshold - eps
    return key[good] // len(index.items), key[good] % len(index.items), score[good]


def overlaps(index: Index, item: int, text_shingles: dict[int, set]) -> tuple[float, float]:
    """Shares of the item's question and answer shingles found in the text's (by width)."""

    def share(part: set) -> float:
        return len(part & text_shingles[len(next(iter(part)))]) / len(part) if part else 1.0

    return share(index.questions[item]), share(index.answers[item])


def overlaps_nearby(index: Index, item: int, passage: list[bytes]) -> tuple[float, float]:
    """Shares of the item's steady question and answer shingles found in the passage, no
    further from what is found of the other part than the item is long."""
    size, parts, whole = index.sizes[item], index.steady[item], (index.questions[item], index.answers[item])
    hits = []
    for part in parts:
        width = len(next(iter(part))) if part else 0
        grams = zip(*(passage[i:] for i in range(width)), strict=False) if part else ()
        hits.append([(at, g) for at, g in enumerate(grams) if g in part])

    def share(n: int) -> float:
        part, own, other = parts[n], hits[n], hits[1 - n]
        if not whole[n]:
            return 1.0
        if not part:
            return 0.0
        if whole[1 - n]:
            places = [at for at, _ in other]
            near = [bisect_left(places, at - size) < bisect_right(places, at + size) for at, _ in own]
            return len({g for (_, g), good in zip(own, near, strict=True) if good}) / len(part)
        if len(next(iter(part))) == 1:
            return 0.0
        return max((len({g for at, g in own if first <= at < first + 2 * size}) for first, _ in own), default=0) / len(part)

    return share(0), share(1)


class _ByWidth(dict):
    """A text's shingles of each width, made when asked for."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        self.words = words

    def __missing__(self, width: int) -> set:
        made = self[width] = set(zip(*(self.words[i:] for i in range(width)), strict=False))
        return made


def find(index: Index, docs: list[bytes], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(document, item, score, question overlap, answer overlap) of the contaminated texts."""
    words = [words_of(d) for d in docs]
    out = []
    at = 0
    while at < len(docs):
        begin, spans = at, []
        while at < len(docs) and (at == begin or len(spans) * index.n_blocks < CELLS):
            spans += [(at, s) for s in range(0, max(1, len(words[at]) - index.stride), index.stride)] if words[at] else []
            at += 1
        flat = [w for d in range(begin, at) for w in words[d]]
        ids = np.fromiter(map(index.vocabulary.get, flat, [-1] * len(flat)), np.int64, len(flat))
        lengths = np.array([len(words[d]) for d in range(begin, at)])
        offset = np.cumsum(lengths) - lengths
        if not spans:
            continue
        lots = max(1, CELLS // index.n_blocks)
        for lot in range(0, len(spans), lots):
            out += _find_lot(index, spans[lot : lot + lots], begin, offset, lengths, ids, words, threshold, overlap)
    best: dict[tuple[int, int], tuple] = {}
    for row in out:
        if row[:2] not in best or row[2] > best[row[:2]][2]:
            best[row[:2]] = row
    return sorted(best.values())


def _find_lot(index, spans, begin, offset, lengths, ids, words, threshold, overlap):
    doc = np.array([d for d, _ in spans])
    lo = offset[doc - begin] + np.array([s for _, s in spans])
    hi = np.minimum(lo + 2 * index.stride, (offset + lengths)[doc - begin])
    owner, place = _spread(np.r_[0, np.cumsum(hi - lo)], np.arange(len(spans)))
    term = ids[lo[owner] + place - (np.cumsum(hi - lo) - (hi - lo))[owner]]
    known = term >= 0
    pair = np.unique(owner[known] * len(index.vocabulary) + term[known])
    passage, item, score = retrieve(index, pair // len(index.vocabulary), pair % len(index.vocabulary), len(spans), threshold)
    found, own = [], {}
    starts = np.array([s for _, s in spans])[passage].tolist()
    for d, i, s, start in zip(doc[passage].tolist(), item.tolist(), score.tolist(), starts, strict=True):
        if d not in own:
            own[d] = _ByWidth(words[d])
        q, a = overlaps(index, i, own[d])
        loose = index.loose[i]
        if any(loose) or q < overlap or a < overlap:
            near = overlaps_nearby(index, i, words[d][start : start + 2 * index.stride])
            q, a = (n if free else max(w, n) for w, n, free in zip((q, a), near, loose, strict=True))
        if q >= overlap and a >= overlap:
            found.append((d, index.items[i], s, q, a))
    return found


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def indexes(benchmark: DataFrame) -> Iterator[tuple[int, Index]]:
    """(number of slices, index) of each slice of ``benchmark(item_id, text)``, one after the other."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"item_id": batch.column("item_id"), "text": batch.column("text"), "words": [words_of(t) for t in texts(batch)]}

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    bags = cut(map_arrow(items, "item_id long, text string, words array<binary>", step).where("size(words) > 0"))
    n_items, mean, size = bags.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.size("words"))).first()
    if not n_items:
        return
    n = -(-size // SLICE_WORDS)
    placed = bags.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    each = placed.select("slice", F.explode(F.array_distinct("words")).alias("word"))
    frequency = cut(each.groupBy("word").count()) if n > 1 else each.groupBy("word").count()
    for at in range(n):
        own = placed.where(F.col("slice") == at).select("item_id", "text").orderBy("item_id", "text").collect()
        known = frequency if n == 1 else frequency.join(each.where(F.col("slice") == at).select("word").distinct(), "word")
        words = {bytes(r["word"]): r["count"] for r in known.collect()}
        yield n, build_index([(r["item_id"], r["text"]) for r in own], Statistics(n_items, mean, words))


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): which of
    ``documents(doc_id, text)`` hold which of ``benchmark(item_id, text)``."""
    rows, found = documents.select(F.col("doc_id").cast("long"), "text"), []
    for n, index in indexes(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(index)
        one = _pass(rows, shared, threshold, overlap)
        found.append(one if n == 1 else cut(one))
        if n > 1:
            shared.unpersist()
    return reduce(DataFrame.unionAll, found, documents.sparkSession.createDataFrame([], SCHEMA))


def _pass(rows: DataFrame, shared, threshold: float, overlap: float) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        found = find(shared.value, texts(batch), threshold, overlap)
        ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
        names = ("item_id", "score", "question_overlap", "answer_overlap")
        return {"doc_id": ids} | {n: [f[k] for f in found] for k, n in enumerate(names, 1)}

    return map_arrow(rows, SCHEMA, step)


def with_flag(documents: DataFrame, benchmark: DataFrame, name: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``documents(text, ...)`` and ``name``: true where a text holds an item of ``benchmark(item_id, text)``."""
    spark, key, keys = documents.sparkSession, fresh_name(documents, "text_key"), []
    for n, index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)
        if n == 1:
            return with_column_of_text(documents, name, T.BooleanType(), _flags(shared, threshold, overlap))
        found = with_column_of_text(documents.select("text"), "held", T.BooleanType(), _flags(shared, threshold, overlap))
        keys.append(cut(found.where("held").select(_text_key().alias(key)).distinct()))
        shared.unpersist()
    if not keys:
        return documents.withColumn(name, F.lit(False))
    held = cut(reduce(DataFrame.unionAll, keys).distinct().withColumn(name, F.lit(True)))
    held = F.broadcast(held) if held.count() <= BROADCAST_KEYS else held
    joined = documents.withColumn(key, _text_key()).join(held, key, "left")
    return joined.select(*documents.columns, F.coalesce(name, F.lit(False)).alias(name))


def _text_key() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _flags(shared, threshold: float, overlap: float):
    def step(own: list[bytes]) -> list[bool]:
        held = {f[0] for f in find(shared.value, own, threshold, overlap)}
        return [n in held for n in range(len(own))]

    return step


def op4_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))
