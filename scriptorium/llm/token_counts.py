"""Token counts that follow edits, by segment trees over pre-token runs.

Pre-tokens of a byte-level BPE never go on over a run of spaces or newlines that follows
another character, so a text is cut there into *units* whose counts add up. A document's
tree has one leaf for each LEAF_UNITS units and sums of characters and tokens above. An
edit finds its leaves by character sums, is applied to their text, takes in neighbouring
leaves for as long as the ends of the region are no such cut any more, re-encodes the
region alone, and updates the sums on the paths to the root. A leaf that has grown beyond
GROWN times its size makes the tree be cut anew, without encoding.

Defined cases: null text is empty and has no tokens; an edit's position is cut to the
text, and so is the stretch it removes; null edits or null fields change nothing (no
position: 0); edits of a document apply in order of ``seq``, each to the text that the one
before left; edits of unknown documents are dropped, documents without edits stay;
repeated documents each get all edits of their id; only the named columns are read.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.arrow import map_arrow, texts
from scriptorium.session import table

LEAF_UNITS, GROWN = 32, 4
CACHE_UNITS = 400_000
FAST_UNITS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: What the query's edits put in.
INSERTED = ["", " and", "\nNew line.", " 1234", "xyz", "'s"]


def load_encoding(ranks_path: str | None = None) -> tiktoken.Encoding:
    """A byte-level BPE from a file of ranks (default: the public 50k one)."""
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Token counts of units, remembered."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, unit: str) -> int:
        n = len(self.encoding.encode_ordinary(unit))
        if len(unit) <= 64:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = n
        return n


def units_of(text: str) -> list[str]:
    """The text cut before each run of spaces or newlines that follows a character of no space."""
    if not text:
        return []
    return CUT.split(text) if OTHER_SPACE.search(text) else FAST_UNITS.findall(text)


def _is_cut(text: str, at: int) -> bool:
    """Whether units end at this place."""
    return at <= 0 or at >= len(text) or (text[at] in " \n" and not text[at - 1].isspace())


class Tree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, text: str, leaves: list[tuple[int, int]]):
        self.text, self.encoded = text, 0
        self._build(leaves)

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        return cls(text, cls._cut(text, counter))

    @staticmethod
    def _cut(text: str, counter: Counter) -> list[tuple[int, int]]:
        units = units_of(text)
        out = []
        for at in range(0, len(units), LEAF_UNITS):
            some = units[at : at + LEAF_UNITS]
            out.append((sum(map(len, some)), sum(map(counter.__getitem__, some))))
        return out

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        pad = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [c for c, _ in leaves] + pad
        self.tokens = [0] * self.size + [t for _, t in leaves] + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> list[tuple[int, int]]:
        return [x for x in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if x[0]]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last that holds any, for the end) and where it starts."""
        i, start = 1, 0
        at = min(at, self.chars[1] - 1)
        while i < self.size:
            left = self.chars[2 * i]
            i, start, at = (2 * i, start, at) if at < left else (2 * i + 1, start + left, at - left)
        return i, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        self.chars[leaf], self.tokens[leaf] = chars, tokens
        i = leaf // 2
        while i:
            self._sum(i)
            i //= 2

    def edit(self, at: int, removed: int, inserted: str, counter: Counter) -> None:
        """Replaces ``removed`` characters at ``at`` by ``inserted``."""
        text = self.text
        at = min(max(at, 0), len(text))
        end = min(at + max(removed, 0), len(text))
        if at == end and not inserted:
            return
        new = text[:at] + inserted + text[end:]
        if not text:
            self.text, self.encoded = new, self.encoded + len(new)
            self._build(self._cut(new, counter))
            return
        (first, lo), (last, last_start) = self.find(at), self.find(max(at, end - 1))
        hi = last_start + self.chars[last]
        shift = len(new) - len(text)
        while lo > 0 and not _is_cut(new, lo):
            first, lo = self.find(lo - 1)
        while hi < len(text) and not _is_cut(new, hi + shift):
            last, last_start = self.find(hi)
            hi = last_start + self.chars[last]
        region = new[lo : hi + shift]
        self.encoded += len(region)
        self.text = new
        cut = self._cut(region, counter)
        span = [i for i in range(first, last + 1) if self.chars[i] or i == first]
        if len(cut) > GROWN * len(span):
            head = list(zip(self.chars[self.size : first], self.tokens[self.size : first], strict=True))
            tail = list(zip(self.chars[last + 1 :], self.tokens[last + 1 :], strict=True))
            self._build([x for x in head + cut + tail if x[0]])
            return
        per = -(-len(cut) // len(span)) if cut else 0
        for n, leaf in enumerate(span):
            some = cut[n * per : (n + 1) * per]
            self._set(leaf, sum(c for c, _ in some), sum(t for _, t in some))


TREE_SCHEMA = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"


def build_trees(documents: DataFrame, ranks_path: str | None = None, keep: str | None = None) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, n_tokens) of each row of ``documents(doc_id, text)``;
    ``keep`` names an ``array<struct<seq,at,removed,inserted>>`` column to carry along."""
    made: list[Counter] = []

    def step(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Counter(load_encoding(ranks_path)))
        own = [t.decode("utf-8", "surrogatepass") for t in texts(batch)]
        leaves = [Tree._cut(t, made[0]) for t in own]
        out = {
            "doc_id": batch.column("doc_id"),
            "text": batch.column("text"),
            "leaf_chars": [[c for c, _ in x] for x in leaves],
            "leaf_tokens": [[t for _, t in x] for x in leaves],
            "n_tokens": [sum(t for _, t in x) for x in leaves],
        }
        return out | ({keep: batch.column(keep)} if keep else {})

    more = f", {keep} {EDITS_TYPE}" if keep else ""
    return map_arrow(documents.select("doc_id", "text", *([keep] if keep else [])), TREE_SCHEMA + more, step)


EDITS_TYPE = "array<struct<seq:int,at:long,removed:long,inserted:string>>"
EDITED_SCHEMA = TREE_SCHEMA + ", old_tokens long, encoded_chars long"


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the edits ``(doc_id, seq, at, removed, inserted)`` of each document."""
    kinds = {"seq": "int", "at": "long", "removed": "long", "inserted": "string"}
    one = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("edits"))
    return trees.join(lists, "doc_id", "left")


def apply_edits(trees: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Trees after the edits in their column ``edits``, with the count before and the number
    of characters that were encoded for it."""
    made: list[Counter] = []

    def step(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Counter(load_encoding(ranks_path)))
        out: dict[str, list] = {n: [] for n in ("text", "leaf_chars", "leaf_tokens", "n_tokens", "encoded_chars")}
        columns = (batch.column(c).to_pylist() for c in ("leaf_chars", "leaf_tokens", "edits"))
        for text, chars, tokens, edits in zip(texts(batch), *columns, strict=True):
            tree = Tree(text.decode("utf-8", "surrogatepass"), list(zip(chars or [], tokens or [], strict=True)))
            for e in edits or []:
                if e:
                    tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "", made[0])
            leaves = tree.leaves()
            for name, value in (("text", tree.text), ("leaf_chars", [c for c, _ in leaves]), ("leaf_tokens", [t for _, t in leaves]), ("n_tokens", tree.total), ("encoded_chars", tree.encoded)):
                out[name].append(value)
        return out | {"doc_id": batch.column("doc_id"), "old_tokens": batch.column("n_tokens")}

    return map_arrow(trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "edits"), EDITED_SCHEMA, step)


def query_edits(doc_id: Column, size: Column) -> Column:
    """Three edits of a document at places that its id and length (in characters) decide."""

    def one(n: int) -> Column:
        draw = lambda k, most: F.pmod(F.xxhash64(F.lit(100 * n + k), doc_id), most)
        kinds = F.array(*map(F.lit, INSERTED))
        return F.struct(
            F.lit(n).alias("seq"),
            draw(1, F.greatest(size, F.lit(0)) + 1).cast("long").alias("at"),
            draw(2, F.lit(12)).cast("long").alias("removed"),
            F.element_at(kinds, (draw(3, F.lit(len(INSERTED))) + 1).cast("int")).alias("inserted"),
        )

    return F.array(*map(one, range(3)))


def op3_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and that after three edits, from its tree."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    planned = documents.withColumn("edits", query_edits(F.col("doc_id"), F.length("text")))
    edited = apply_edits(build_trees(planned, keep="edits"))
    return edited.select(
        "doc_id",
        F.col("old_tokens").alias("n_tokens"),
        F.col("n_tokens").alias("edited_tokens"),
        F.length("text").cast("long").alias("edited_chars"),
        F.crc32(F.col("text").cast("binary")).alias("edited_crc32"),
        "encoded_chars",
        F.size("leaf_tokens").cast("long").alias("n_leaves"),
    )
