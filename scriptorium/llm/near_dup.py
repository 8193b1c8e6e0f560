"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is that of its word shingles. Equal sets are one *set* from then on, so
exact copies cost nothing further. Each set has TOKENS minwise tokens, of a byte each. In
each of ``trees`` independent trees, a node is a path of (coordinate, token) choices; which
coordinates a node branches on is a keyed hash of the node: one, or in a quarter of all
nodes two, so that a set moves to 1.25 children on average and a pair of similarity 0.8
stays together in one of them as a whole. Sets of low similarity part after a few levels.

* Nodes are first counted at FIRST_LEVEL, as paths down to there need no exchange. A node
  of one set ends; one of up to BIG sets is compared exhaustively on the minwise tokens;
  a larger one branches on.
* A larger node whose sets resemble each other (``DENSE``), or that is left at the last
  level, would not part: all of its sets count as agreeing.

Each node gives a star of its agreeing sets, not all pairs. The components of these stars
are *groups*: every pair that agrees in some node is inside one. Then the full sets, made
anew from the texts, are sent to their group once and linked there exactly, all pairs of a
group, in one task; only a star of links leaves it. A group of too many or too long sets is
split into blocks that all hold some pivots of the group; once their links are joined,
whatever is outside the group's largest component meets every set of the group, block by
block. So every link inside a group is found, and what is written grows with the sets of
a group, but for those outside of its largest component.

Recall: a pair of similarity 0.8 meets in one tree with probability 0.58 after four levels,
0.48 after six, 0.32 after twelve; twelve trees on the same tokens miss 8e-5, 8e-4 and 2e-2
(``missed``). So sets of nodes that branch on where the trees miss too much go through
further rounds of trees, each on fresh tokens, until the rounds, each taken at its deepest
level, miss MISS / 2 together. With the pairs that part before and those whose tokens
disagree too much (3e-5), a link is missed with probability MISS at most, however deep the
nodes are.

Defined cases: null, empty or blank text has no set and is linked with nothing; a text of
fewer words than a shingle has its whole sequence as one shingle; repeated rows are exact
copies, and rows that repeat an id repeat its decision; a null id never is a component's
id unless nothing else is in it; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.arrow import fresh_name, map_arrow, texts
from scriptorium.llm.components import connected_components
from scriptorium.session import cut, table

#: Minwise tokens of a set, a byte each; agreement of a pair is asked for to DEVIATIONS below the mean.
TOKENS, DEVIATIONS = 256, 4.2
TREES, FIRST_LEVEL, BIG, LAST_LEVEL = 12, 4, 512, 12
#: A pair that is just similar enough is missed with this probability at most.
MISS = 5e-4
#: A node is dense if its sampled sets agree in so many tokens on average.
DENSE, PROBES = 160, 8
#: Sets and shingles of a block of full sets, about; pivots that every block of a group holds.
BLOCK, BLOCK_SHINGLES, PIVOTS = 400, 500_000, 8
#: Columns of the dense products that count common shingles.
WIDTH = 2048
#: Ids that may be broadcast to pick documents; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows of tokens or of the like in a partition, where there may be fewer partitions than usual.
PART_ROWS = 5_000
CACHE_WORDS = 100_000


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, (2, TOKENS // 2), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles (A-Z lower-cased, words parted by
    ASCII white space)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(_mix(total))


def minwise_tokens(sets: list[np.ndarray], seed: int = 1) -> np.ndarray:
    """For non-empty sets: a byte of each of TOKENS minwise values, then the size in four
    bytes, as (sets, TOKENS + 4). Each mixed hash gives two values, its halves."""
    multipliers = _multipliers(seed)
    out = np.empty((len(sets), TOKENS + 4), dtype=np.uint8)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 16_384):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for t in range(TOKENS // 2):
            x = flat * multipliers[0, t]
            x = (x ^ (x >> np.uint64(29))) * multipliers[1, t]
            halves = np.minimum.reduceat((x ^ (x >> np.uint64(32))).view(np.uint32).reshape(-1, 2), starts, axis=0)
            out[at:end, 2 * t : 2 * t + 2] = (halves ^ halves >> 11) & 255
        at = end
    out[:, TOKENS:] = np.array([len(s) for s in sets], dtype="<u4").view(np.uint8).reshape(-1, 4)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, TOKENS + 4)


def _row_key() -> F.Column:
    """128 bits that name a row by its id and text."""
    return F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))))


def with_sets(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, row_key, set_id, n_shingles, tokens) of each row of ``documents(doc_id, text)``."""

    def step(batch: pa.RecordBatch) -> dict:
        sets = [shingle_hashes(t, k) for t in texts(batch)]
        full = [s for s in sets if len(s)]
        tokens = iter(minwise_tokens(full)) if full else iter(())
        return {
            "doc_id": batch.column("doc_id"),
            "row_key": batch.column("row_key"),
            "set_id": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "n_shingles": [len(s) for s in sets],
            "tokens": [next(tokens).tobytes() if len(s) else None for s in sets],
        }

    keyed = documents.select(F.col("doc_id").cast("long"), "text", _row_key().alias("row_key"))
    return map_arrow(keyed, "doc_id long, row_key binary, set_id binary, n_shingles long, tokens binary", step)


def branch(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down from the nodes that the rows of ``tokens`` are in: (row, child) pairs."""
    first = _mix(node ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(TOKENS)
    second = (first + np.uint64(1) + _mix(node ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
    twice = np.flatnonzero(_mix(node ^ np.uint64(0x165667B19E3779F9)) & np.uint64(3) == 0)
    rows = np.concatenate([np.arange(len(node)), twice])
    place = np.concatenate([first, second[twice]])
    token = tokens[rows, place.astype(np.int64)].astype(np.uint64)
    return rows, _mix(node[rows] * np.uint64(0x9FB21C651E98DF25) + place * np.uint64(256) + token + np.uint64(1))


def _node_rows(batch: pa.RecordBatch, rows: np.ndarray, nodes: np.ndarray) -> dict:
    return {"node": nodes.view(np.int64), "id": batch.column("id").to_numpy()[rows]}


def _first_nodes(sets: DataFrame, roots: range) -> DataFrame:
    """(node, id) of the nodes at FIRST_LEVEL that the sets (id, tokens) come to."""

    def step(batch: pa.RecordBatch) -> dict:
        tokens = _matrix(batch.column("tokens"))
        starts = _mix(np.array(roots, dtype=np.uint64) + np.uint64(17))
        rows, nodes = np.tile(np.arange(len(tokens)), len(roots)), np.repeat(starts, len(tokens))
        for _ in range(FIRST_LEVEL):
            into, nodes = branch(nodes, tokens[rows])
            rows = rows[into]
        return _node_rows(batch, rows, nodes)

    return map_arrow(sets.select("id", "tokens"), "node long, id long", step, column="tokens")


def _next_nodes(rows: DataFrame) -> DataFrame:
    """(node, id, tokens) one level below ``rows(node, id, tokens)``."""

    def step(batch: pa.RecordBatch) -> dict:
        rows, nodes = branch(batch.column("node").to_numpy().view(np.uint64), _matrix(batch.column("tokens")))
        return _node_rows(batch, rows, nodes) | {"tokens": batch.column("tokens").take(pa.array(rows))}

    return map_arrow(rows.select("node", "id", "tokens"), "node long, id long, tokens binary", step, column="tokens")


def _least_agreement(percent: int) -> float:
    p = percent / 100
    return TOKENS * p - DEVIATIONS * math.sqrt(TOKENS * p * (1 - p))


def _alike(rows: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``rows`` of tokens and sizes may have a similarity of ``percent`` with which of
    ``others`` (broadcast against each other)."""
    sizes, theirs = (np.ascontiguousarray(x[..., TOKENS:]).view("<u4").astype(np.int64)[..., 0] for x in (rows, others))
    fits = 100 * np.minimum(sizes, theirs) >= percent * np.maximum(sizes, theirs)
    return fits & ((rows[..., :TOKENS] == others[..., :TOKENS]).sum(-1) >= _least_agreement(percent))


def _parts(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix, the least row of its connected part."""
    label = np.arange(len(near))
    while True:
        reached = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        reached = reached[reached]
        if (reached == label).all():
            return label
        label = reached


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """The rows of each run of equal ``by`` in sorted batches; only one run and batch is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(by).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        if held and held[-1].column(by)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) from the sets of each node of ``rows(node, id, tokens)`` to the least set
    of those that they agree with, directly or by others of the node.

    Rows of a node come together by a shuffle; only one batch and one node, of BIG rows at
    most, are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TOKENS + 4), np.uint8)]

        def stars(node: np.ndarray, ids: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
            start = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]]) if len(node) else np.zeros(1, int)
            size = np.diff(start)
            two = start[:-1][size == 2]
            two = two[_alike(tokens[two], tokens[two + 1], percent)]
            u, v = [ids[two + 1]], [ids[two]]
            for lo, n in zip(start[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                order = lo + np.argsort(ids[lo : lo + n], kind="stable")
                own, sketch = ids[order], tokens[order]
                near = np.vstack([_alike(sketch[at : at + 32, None, :], sketch[None, :, :], percent) for at in range(0, n, 32)])
                least = own[_parts(near)]
                u.append(own[own != least])
                v.append(least[own != least])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids = (np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("node", "id"), strict=False))
            tokens = np.vstack([rest[2], _matrix(batch.column("tokens"))])
            keep = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            yield stars(node[:keep], ids[:keep], tokens[:keep])
            rest = [node[keep:], ids[keep:], tokens[keep:]]
        yield stars(*rest)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "u long, v long")


def _dense(large: DataFrame, level: int) -> DataFrame:
    """(node) of the nodes of ``large(node, id, tokens)`` whose PROBES sets, those of the least
    keyed hashes, agree in DENSE tokens on average; all nodes at the last level."""
    if level == LAST_LEVEL:
        return large.select("node").distinct()
    probes = [F.min_by("tokens", F.xxhash64(F.lit(seed), "id")) for seed in range(PROBES)]

    def step(batch: pa.RecordBatch) -> dict:
        agree = []
        for row in batch.column("probes").to_pylist():
            x = np.frombuffer(b"".join(row), dtype=np.uint8).reshape(len(row), TOKENS + 4)[:, :TOKENS]
            agree.append(float(np.mean([(x[i] == x[j]).sum() for i in range(len(x)) for j in range(i)] or [TOKENS])))
        return {"node": batch.column("node"), "agree": agree}

    probed = large.groupBy("node").agg(F.array_distinct(F.array(*probes)).alias("probes"))
    return map_arrow(probed, "node long, agree double", step, column="probes").where(F.col("agree") >= DENSE).select("node")


def missed(level: int, trees: int, percent: int = 80) -> float:
    """The probability that a pair of similarity ``percent`` comes together to ``level`` in
    none of ``trees`` trees on the same tokens: over the number of tokens that agree, as
    the trees are independent only for given tokens."""

    def together(p: float) -> float:
        out = 1.0
        for _ in range(level):
            out = 0.75 * p * out + 0.25 * (1 - (1 - p * out) ** 2)
        return out

    p = percent / 100
    return sum(math.comb(TOKENS, n) * p**n * (1 - p) ** (TOKENS - n) * (1 - together(n / TOKENS)) ** trees for n in range(TOKENS + 1))


def safe_level(trees: int, percent: int) -> int:
    """The deepest level to which ``trees`` trees miss MISS / 2 at most; 0 if there is none
    at which nodes end."""
    return max((level for level in range(FIRST_LEVEL, LAST_LEVEL + 1) if missed(level, trees, percent) <= MISS / 2), default=0)


def nodes_of(sets: DataFrame, roots: range, safe: int = LAST_LEVEL) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Of ``sets(id, tokens)``: the rows (node, id) of nodes of 2 to BIG sets, the rows
    (node, id) of larger nodes that do not part any more, the ids (id) of sets that branch
    on at level ``safe`` (none: None), and the deepest level at which a node ended.
    ``roots`` numbers the trees."""
    small, dense = [], sets.sparkSession.createDataFrame([], "node bigint, id bigint")
    live, rows = None, _first_nodes(sets, roots)
    for level in range(FIRST_LEVEL, LAST_LEVEL + 1):
        sizes = cut(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))
        n_large = sizes.where(F.col("size") > BIG).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shared = cut(rows.join(sizes, "node"))
        small.append(shared.where(F.col("size") <= BIG).select("node", "id"))
        if not n_large:
            break
        large = shared.where(F.col("size") > BIG)
        large = large if level > FIRST_LEVEL else large.join(sets, "id")
        large = _packed(cut(large.select("node", "id", "tokens")), n_large)
        held = cut(_packed(_dense(large, level), n_large // BIG))
        dense = dense.unionAll(large.select("node", "id").join(held, "node", "left_semi"))
        going = large.join(held, "node", "left_anti")
        if level == safe:
            live = cut(_packed(going.select("id").distinct(), n_large))
        rows = cut(_packed(_next_nodes(going), n_large))
    return reduce(DataFrame.unionAll, small), dense, live, level


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, about ``n`` of them, in as few partitions as PART_ROWS allows. To be used on
    what is written, or is made of ``n`` rows alone, as it holds for the steps before too."""
    return rows.coalesce(1 + n // PART_ROWS)


def _fresh(ids: DataFrame, keys: DataFrame, documents: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, tokens) of the sets ``ids(id)`` with other minwise tokens."""

    def step(batch: pa.RecordBatch) -> dict:
        sets = [shingle_hashes(t, k) for t in texts(batch)]
        return {"id": batch.column("id"), "tokens": [t.tobytes() for t in minwise_tokens(sets, seed)] if sets else []}

    return map_arrow(_chosen(keys.join(ids, "id", "left_semi").select("row_key", "id"), documents), "id long, tokens binary", step).dropDuplicates(["id"])


def agreeing(sets: DataFrame, keys: DataFrame, documents: DataFrame, k: int, percent: int, trees: int) -> DataFrame:
    """Edges (u, v) whose components hold every pair of agreeing sets of a node, from as many
    rounds of ``trees`` trees as MISS asks for."""

    def edges(small: DataFrame, dense: DataFrame, own: DataFrame) -> DataFrame:
        dense = cut(dense)
        least = cut(_packed(dense.groupBy("node").agg(F.min("id").alias("v")), dense.count() // BIG))
        held = dense.join(least, "node").where("id > v").select(F.col("id").alias("u"), "v")
        return _stars(small.join(own, "id").select("node", "id", "tokens"), percent).unionAll(held)

    safe = safe_level(trees, percent)
    small, dense, live, level = nodes_of(sets, range(trees), safe)
    found = edges(small, dense, sets)
    if not safe:
        live = sets.select("id")
    miss, turn = missed(level, trees, percent), 1
    while live is not None and miss > MISS / 2 and not live.isEmpty():
        again = cut(_packed(_fresh(live, keys, documents, k, turn + 1), live.count()))
        small, dense, _, level = nodes_of(again, range(turn * trees, (turn + 1) * trees))
        found = found.unionAll(edges(small, dense, again))
        miss, turn = miss * missed(level, trees, percent), turn + 1
    return found


def _chosen(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """``wanted(row_key, ...)`` with the text of the documents of that row key."""
    return documents.select("text", _row_key().alias("row_key")).join(_sized(wanted), "row_key").drop("row_key")


def _hashed(members: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(id, part, hashes): the full sets of ``members(id, part, row_key, n_rows)``, once each.
    Only a set of several rows may have repeated documents."""

    def full(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "part": batch.column("part"), "hashes": [shingle_hashes(t, k).tobytes() for t in texts(batch)]}

    made = lambda some: map_arrow(_chosen(some.select("row_key", "id", "part"), documents), "id long, part long, hashes binary", full)
    return made(members.where("n_rows = 1")).unionAll(made(members.where("n_rows > 1")).dropDuplicates(["id"]))


def common_shingles(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many shingles the sets numbered ``rows`` share with each of ``sets``: products of
    0-1 matrices of WIDTH shingles at a time, of those that at least two sets hold."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    code = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]]))
    held = np.bincount(code) > 1
    keep = held[code]
    code, owner = (np.cumsum(held) - 1)[code[keep]], owner[keep]
    common = np.zeros((len(rows), n), dtype=np.float32)  # whole numbers below 2**24 are exact
    for at in range(0, int(held.sum()), WIDTH):
        lo, hi = np.searchsorted(code, [at, at + WIDTH])
        some = np.zeros((n, WIDTH), dtype=np.float32)
        some[owner[lo:hi], code[lo:hi] - at] = 1
        common += some[rows] @ some.T
    return common.astype(np.int64)


def linked(sets: list[np.ndarray], outside: np.ndarray, percent: int) -> np.ndarray:
    """Which sets are linked, as a symmetric matrix: 100 * intersection >= percent * union; of
    pairs of which neither is ``outside``, none."""
    sizes, rows = np.array([len(s) for s in sets]), np.flatnonzero(outside)
    common = common_shingles(sets, rows)
    near = np.zeros((len(sets), len(sets)), dtype=bool)
    near[rows] = 100 * common >= percent * (sizes[rows, None] + sizes[None, :] - common)
    return near | near.T


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that join what is linked in each block of ``rows(block, id, label, outside,
    hashes)``, one or none for each row: from its label to the least one that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, "block"):
            outside = block.column("outside").to_numpy(zero_copy_only=False)
            if block.num_rows < 2 or not outside.any():
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in block.column("hashes").to_pylist()]
            names, label = np.unique(block.column("label").to_numpy(), return_inverse=True)
            near = linked(sets, outside, percent)
            first = np.unique(label, return_index=True)[1][label]
            near[np.arange(len(label)), first] = near[first, np.arange(len(label))] = True  # one label is one part
            least = np.full(len(sets), len(names))
            part = _parts(near)
            np.minimum.at(least, part, label)
            edges = np.unique(np.stack([names[label], names[least[part]]]), axis=1)
            edges = edges[:, edges[0] != edges[1]]
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"])

    kept = rows.select("block", "id", "label", "outside", "hashes")
    return kept.repartition("block").sortWithinPartitions("block").mapInArrow(run, "u long, v long")


def _blocks(members: DataFrame) -> DataFrame:
    """Rows (block, id, label, outside) that send the sets ``members(part, id, blocks)`` of split
    groups to one of their group's blocks, and the group's pivots to all of them."""
    block = lambda i: F.xxhash64("part", i)
    own = members.select(block(F.pmod(F.xxhash64("id"), "blocks")).alias("block"), "id")
    least = [F.min_by("id", F.xxhash64(F.lit(seed), "id")) for seed in range(PIVOTS)]
    pivots = members.groupBy("part", "blocks").agg(F.array_distinct(F.array(*least)).alias("pivots"))
    every = pivots.select("part", "pivots", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("i")).select(block(F.col("i")).alias("block"), F.explode("pivots").alias("id"))
    return own.unionAll(every).distinct().withColumns({"label": F.col("id"), "outside": F.lit(True)})


def _outside(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (block, id, label, outside) of blocks in which whatever is outside the largest
    component of a split group ``members(part, id, blocks)`` meets all of the group."""
    named = cut(members.join(found, members["id"] == found["node"], "left").select("part", "id", "blocks", F.coalesce("component", "id").alias("label")))
    largest = named.groupBy("part", "label").count().groupBy("part").agg(F.max_by("label", F.struct("count", "label")).alias("core"), F.sum("count").alias("n"), F.max("count").alias("in_core"))
    known = named.join(cut(largest.where("in_core < n")), "part").withColumn("outside", F.col("label") != F.col("core"))
    chunks = F.ceil(F.col("blocks") * (F.col("n") - F.col("in_core")) / F.col("n"))
    to = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    kept = ["part", "id", "label", "outside"]
    everyone = known.select(*kept, F.pmod(F.xxhash64("id"), "blocks").alias("i"), F.explode(to(chunks)).alias("j"))
    others = known.where("outside").select(*kept, F.explode(to(F.col("blocks"))).alias("i"), F.pmod(F.xxhash64(F.lit(9), "id"), chunks).alias("j"))
    return everyone.unionAll(others).select(F.xxhash64("part", "i", "j").alias("block"), "id", "label", "outside").distinct()


def linked_sets(sets: DataFrame, documents: DataFrame, k: int, percent: int, trees: int = TREES) -> DataFrame:
    """(node, component) of every set of ``sets(id, tokens, row_key, n_shingles, n_rows)`` that
    is linked with another one."""
    keys = sets.select("id", "row_key")
    groups = connected_components(agreeing(sets.select("id", "tokens"), keys, documents, k, percent, trees))
    groups = cut(groups)
    n = groups.count()
    placed = _packed(cut(groups.withColumnsRenamed({"node": "id", "component": "part"}).join(sets.select("id", "n_shingles", "row_key", "n_rows"), "id")), n)
    most = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES))
    large = cut(_packed(placed.groupBy("part").agg(most.alias("blocks")).where("blocks > 1"), n))  # few: BLOCK sets or BLOCK_SHINGLES shingles each
    whole = _hashed(placed.join(large, "part", "left_anti"), documents, k)
    found = _packed(cut(_links(whole.select(F.col("part").alias("block"), "id", F.col("id").alias("label"), F.lit(True).alias("outside"), "hashes"), percent)), n)
    found = found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(found.select("v", "v").distinct())
    if large.isEmpty():
        return found
    split = cut(_packed(placed.join(large, "part"), n))
    members, sets_of = split.select("part", "id", "blocks"), _packed(cut(_hashed(split, documents, k).drop("part")), split.count())
    links = cut(_links(_blocks(members).join(sets_of, "id"), percent))
    more = _links(_outside(members, connected_components(links)).join(sets_of, "id"), percent)
    return found.unionAll(connected_components(links.unionAll(more)))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, kept, stays) of each row of
    ``documents(doc_id, text)``. ``row_key`` is a hash of id and text; ``stays`` marks one
    row_key of each component: that of the smallest id, or without ids the smallest."""
    rows = cut(with_sets(documents, k))
    full = rows.where("set_id is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("least")
    sets = full.groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_rows"), first)
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()))  # fixed by the checkpoint
    sets = _packed(sets, sets.count())
    found = cut(linked_sets(sets.select("id", "tokens", "n_shingles", "n_rows", "least.row_key"), documents, k, percent, trees))
    joined = sets.join(found, sets["id"] == found["node"]).select("id", "component", "least")
    least = cut(joined.groupBy("component").agg(F.min("least").alias("of_all")))
    named = cut(found.join(least, "component").select("node", "of_all"))
    of_set = sets.join(named, sets["id"] == named["node"], "left").select("set_id", F.coalesce("of_all", "least").alias("to"))
    grouped = full.drop("tokens").join(of_set, "set_id").select("doc_id", "row_key", "n_shingles", F.col("to.doc_id").alias("component_id"), (F.col("row_key") == F.col("to.row_key")).alias("stays"))
    alone = rows.where("set_id is null").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return grouped.unionAll(alone).withColumn("kept", kept)


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """``documents(doc_id, text, ...)`` with one row of each component; rows without a set all stay."""
    key = fresh_name(documents, "row_key")
    judged = cut(near_duplicates(documents, k, percent, trees).select("row_key", "n_shingles", "stays"))
    gone = judged.where("not stays").select(F.col("row_key").alias(key)).distinct()
    twice = judged.where("stays and n_shingles > 0").groupBy(F.col("row_key").alias(key)).count().where("count > 1").select(key)
    keyed = documents.withColumn(key, _row_key())
    left = keyed.join(_sized(gone), key, "left_anti")
    if not twice.isEmpty():  # rows that repeat id and text
        left = left.join(_sized(twice), key, "left_anti").unionAll(left.join(_sized(twice), key, "left_semi").dropDuplicates([key]))
    return left.select(*documents.columns)


def _sized(keys: DataFrame) -> DataFrame:
    """``keys`` with a broadcast hint if there are BROADCAST_KEYS at most."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def op5_chosen_path_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets have similarity 0.8 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sets UNION SELECT node, v FROM reach JOIN links ON other = u
), least AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON node = doc_id
"""
