"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

Encoding keeps an agenda of candidate merges (best score first, then leftmost). Each
candidate is skipped with probability ``dropout``, decided by a hash keyed with seed, text,
the word's place in the text and the span, so the same input and seed give the same pieces
on any machine, and every occurrence of a word is segmented by draws of its own. As a
skipped candidate does not come back, dropping it as it enters the agenda is the same as
skipping it when it is due.

No piece of the model holds a space after another character or a newline beside others
(``load_vocabulary`` refuses models of which this is not so), so words with the spaces
before them are segmented apart. The pieces of a word depend on nothing but which of its
possible merges the draws skip. Occurrences of a word in the texts at hand for which the
same merges are skipped are therefore segmented once, by the draws of the first of them; and
where none of the merges is skipped that the agenda meets without any skipping, the pieces
are those of the word as a whole.

Characters without a piece become byte pieces. Spaces are the model's word mark; a word
mark that stands in the text itself is written as bytes, so decoding restores every text.

Defined cases: null and empty texts have no pieces; one space is put before any other
text, as the model wants, and taken off again; texts and words of any length are encoded
whole (words over LONG characters by a heap); repeated rows are encoded alike; only doc_id
and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.arrow import map_arrow, texts
from scriptorium.session import table

DROPOUT, SEED = 0.1, 20
LONG = 48
#: Words that are segmented together, and words whose possible merges a task remembers, at most.
BATCH_WORDS, CACHE_WORDS = 400_000, 100_000
#: Occurrences in the texts at hand from which on a word's draws are compared before it is segmented.
OFTEN = 6
#: Possible merges of a word whose draws fit a mask; words with more are segmented one by one.
MASK_BITS = 62
#: What a span adds to a draw's key.
_START, _MID, _END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
WORDS = re.compile(r"\n| *[^ \n]+| +")
MARK = "▁"
NEVER = 1 << 60
MASK = (1 << 64) - 1


@dataclass
class Vocabulary:
    """Pieces with spaces for word marks, in order of merging, and their ids."""

    ids: dict[str, int]
    rank: dict[str, int]
    byte_ids: list[int]
    pieces: list[bytes] = field(repr=False)


def load_vocabulary(model_path: str | None = None) -> Vocabulary:
    """Reads a SentencePiece BPE model with byte fallback (default: the public 32k one)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
    ids, pieces, byte_ids, order = {}, [], [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte = int(piece[3:5], 16)
            byte_ids[byte] = i
            pieces.append(bytes([byte]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            own = piece.replace(MARK, " ")
            ids[own] = i
            pieces.append(own.encode())
            order.append((-sp.get_score(i), own))
    odd = [p for p in ids if " " in p.lstrip(" ") or ("\n" in p and p != "\n")]
    if odd:
        raise ValueError(f"the model has pieces over several words, such as {odd[0]!r}")
    ranks = {s: n for n, s in enumerate(sorted({s for s, _ in order}))}
    return Vocabulary(ids, {p: ranks[s] for s, p in order}, byte_ids, pieces)


@dataclass
class Merges:
    """The possible merges of a word: what they add to a draw's key, which of them the agenda meets
    if nothing is skipped (as bits), and the pieces that it then ends with."""

    spans: np.ndarray
    met: int
    whole: bytes


class Encoder:
    """Pieces of texts under one seed and rate of dropout."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.seed = vocabulary, seed
        self.limit = int(dropout * (1 << 32))
        self.known: dict[str, Merges] = {}
        self.kind = np.dtype("<u2" if len(vocabulary.pieces) <= 1 << 16 else "<u4")
        self._tables()

    def _tables(self) -> None:
        """Arrays for many words at once: the piece of a character, the rank of a pair of pieces, the piece of a rank."""
        v = self.v
        self.of_char = np.full(0x110000, -1, dtype=np.int64)
        pairs, ranks = [], []
        self.of_rank = np.zeros(1 + max(v.rank.values()), dtype=np.int64)
        for piece, i in v.ids.items():
            self.of_rank[v.rank[piece]] = i
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for cut in range(1, len(piece)):
                if piece[:cut] in v.ids and piece[cut:] in v.ids:
                    pairs.append(v.ids[piece[:cut]] * len(v.pieces) + v.ids[piece[cut:]])
                    ranks.append(v.rank[piece])
        self.chars = {p for p in v.ids if len(p) == 1}
        self.longest = max(map(len, v.ids))
        order = np.argsort(pairs)
        self.pairs, self.ranks = np.array(pairs, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order]

    def skipped(self, key: int, start: int, mid: int, end: int) -> bool:
        x = (key + start * _START + mid * _MID + end * _END) & MASK
        x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & MASK
        return (x ^ x >> 32) & 0xFFFFFFFF < self.limit

    def segment(self, word: str, key: int) -> list[str]:
        """The pieces of one word by the draws of ``key``."""
        return self._short(word, key) if len(word) <= LONG else self._long(word, key)

    def _short(self, word: str, key: int, met: set | None = None) -> list[str]:
        """``met``: skip nothing, and note the spans of all candidates."""
        rank, skipped, none = self.v.rank, self.skipped, not self.limit or met is not None
        parts, starts = list(word), list(range(len(word) + 1))
        due = []
        for i in range(len(word) - 1):
            r = rank.get(word[i : i + 2], NEVER)
            due.append(r if r == NEVER or none or not skipped(key, i, i + 1, i + 2) else NEVER)
            if met is not None and r != NEVER:
                met.add((i, i + 1, i + 2))
        while due and (best := min(due)) != NEVER:
            i = due.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del starts[i + 1], due[i]
            for j in (i - 1, i):
                if 0 <= j < len(due):
                    r = rank.get(parts[j] + parts[j + 1], NEVER)
                    due[j] = r if r == NEVER or none or not skipped(key, starts[j], starts[j + 1], starts[j + 2]) else NEVER
                    if met is not None and r != NEVER:
                        met.add((starts[j], starts[j + 1], starts[j + 2]))
        return parts

    def _long(self, word: str, key: int) -> list[str]:
        rank = self.v.rank
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the part's start; end -1: merged away
        agenda: list[tuple[int, int, int, int]] = []

        def offer(start: int) -> None:
            mid = end[start]
            if mid < n:
                last = end[mid]
                r = rank.get(word[start:last])
                if r is not None and not (self.limit and self.skipped(key, start, mid, last)):
                    heapq.heappush(agenda, (r, start, mid, last))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, start, mid, last = heapq.heappop(agenda)
            if end[start] != mid or end[mid] != last:
                continue
            end[start], end[mid] = last, -1
            if last < n:
                before[last] = start
            if start:
                offer(before[start])
            offer(start)
        parts, at = [], 0
        while at < n:
            parts.append(word[at : end[at]])
            at = end[at]
        return parts

    def packed(self, word: str, key: int) -> bytes:
        return self._ids(self.segment(word, key))

    def _ids(self, parts: list[str]) -> bytes:
        ids: list[int] = []
        for p in parts:
            i = self.v.ids.get(p)
            if i is None:
                ids.extend(self.v.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                ids.append(i)
        return np.array(ids, dtype=self.kind).tobytes()

    def _skips(self, x: np.ndarray) -> np.ndarray:
        """``skipped`` for many sums of key and span."""
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ x >> np.uint64(32)) & np.uint64(0xFFFFFFFF)) < np.uint64(self.limit)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranks of pairs of pieces, NEVER for those that do not merge or are skipped."""
        pair = np.where((left < 0) | (right < 0), -1, left * len(self.v.pieces) + right)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        rank = np.where(self.pairs[at] == pair, self.ranks[at], NEVER)
        if self.limit:
            live = rank < NEVER
            start, mid, end = (np.broadcast_to(a, pair.shape)[live].astype(np.uint64) for a in (start, mid, end))
            x = np.broadcast_to(key, pair.shape)[live] + start * np.uint64(_START) + mid * np.uint64(_MID) + end * np.uint64(_END)
            rank[live] = np.where(self._skips(x), NEVER, rank[live])
        return rank

    def _many(self, words: list[str], key: np.ndarray) -> list[bytes]:
        """``packed`` for words of similar length without unknown characters or runs of spaces,
        each by the draws of its key."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        column = np.arange(width)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        parts = np.full((n, width), -1, dtype=np.int64)
        parts[column[None, :] < sizes[:, None]] = self.of_char[points]
        starts = np.tile(np.arange(width + 1), (n, 1))
        due = self._pair_ranks(parts[:, :-1], parts[:, 1:], key[:, None], column[None, :-1], column[None, 1:], column[None, 1:] + 1)
        row, out = np.arange(n), [b""] * n

        def finish(done: np.ndarray) -> None:
            own, left = parts[done], sizes[done]
            flat = own[np.arange(own.shape[1])[None, :] < left[:, None]].astype(self.kind).tobytes()
            ends = (np.cumsum(left) * self.kind.itemsize).tolist()
            for r, lo, hi in zip(row[done].tolist(), [0, *ends], ends, strict=False):
                out[r] = flat[lo:hi]

        while due.shape[1]:
            best = due.argmin(1)
            rank = due[np.arange(len(due)), best]
            live = rank < NEVER
            if not live.all():
                finish(~live)
                parts, starts, due, key, row, sizes, best, rank = (a[live] for a in (parts, starts, due, key, row, sizes, best, rank))
                if not len(row):
                    return out
            lines, pick = np.arange(len(row)), best[:, None]
            parts[lines, best] = self.of_rank[rank]
            shift = lambda a, after: np.take_along_axis(a, np.arange(a.shape[1] - 1)[None, :] + (np.arange(a.shape[1] - 1)[None, :] >= after), 1)
            parts, starts, due = shift(parts, pick + 1), shift(starts, pick + 1), shift(due, pick)
            sizes = sizes - 1
            for j in (best - 1, best):
                has = (j >= 0) & (j + 1 < sizes)
                who, c = lines[has], j[has]
                due[who, c] = self._pair_ranks(
                    parts[who, c], parts[who, c + 1], key[who], starts[who, c], starts[who, c + 1], starts[who, c + 2]
                )
        finish(np.ones(len(row), dtype=bool))
        return out

    def merges(self, word: str) -> Merges:
        """What the draws of a word's occurrences are compared by."""
        ids, rank, n, at = self.v.ids, self.v.rank, len(word), {}
        for i in range(n - 1):
            for k in range(i + 2, min(n, i + self.longest) + 1):
                if word[i:k] in rank:
                    for m in range(i + 1, k):
                        if word[i:m] in ids and word[m:k] in ids:
                            at[i, m, k] = len(at)
        met = set()
        parts = self._short(word, 0, met)
        spans = np.array([(i * _START + m * _MID + k * _END) & MASK for i, m, k in at], dtype=np.uint64)
        return Merges(spans, sum(1 << at[x] for x in met if x in at), self._ids(parts))

    def _like(self, distinct: list[str], word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence (number of its word, key): the first occurrence of the same word
        for which the same merges are skipped, and these merges as a mask (-1: not looked at)."""
        own, none = np.arange(len(word)), np.full(len(word), -1, dtype=np.int64)
        counts = np.bincount(word, minlength=len(distinct))
        often = [int(w) for w in np.flatnonzero(counts >= OFTEN) if len(distinct[w]) <= LONG]
        if len(self.known) + len(often) > CACHE_WORDS:
            self.known.clear()
        spans, sizes, met = [], np.full(len(distinct), -1), np.zeros(len(distinct), dtype=np.uint64)
        for w in often:
            found = self.known.get(distinct[w])
            if found is None:
                found = self.known[distinct[w]] = self.merges(distinct[w])
            if len(found.spans) <= MASK_BITS:
                spans.append(found.spans)
                sizes[w], met[w] = len(found.spans), found.met
        known = sizes >= 0
        if not known.any():
            return own, none
        flat = np.concatenate(spans)
        begin = np.zeros(len(distinct), dtype=np.int64)
        begin[known] = np.cumsum(sizes[known]) - sizes[known]
        mask = np.zeros(len(word), dtype=np.uint64)
        drawn = np.flatnonzero(sizes[word] > 0)
        for at in range(0, len(drawn), 1 << 16):
            some = drawn[at : at + (1 << 16)]
            n = sizes[word[some]]
            first = np.cumsum(n) - n
            nth = np.arange(int(n.sum())) - np.repeat(first, n)
            hit = self._skips(np.repeat(key[some], n) + flat[np.repeat(begin[word[some]], n) + nth])
            bits = np.bitwise_or.reduceat(hit.astype(np.uint64) << nth.astype(np.uint64), first)
            mask[some] = np.where(bits & met[word[some]], bits, 0)
        some = np.flatnonzero(known[word])
        mixed = (word[some].astype(np.uint64) * np.uint64(_START)) ^ (mask[some] * np.uint64(_MID))
        _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
        like = some[first][back]
        same = (word[like] == word[some]) & (mask[like] == mask[some])  # two pairs may mix to one number
        own[some[same]] = like[same]
        none[some] = mask[some].astype(np.int64)
        return own, none

    def _segmented(self, words: list[str], key: np.ndarray) -> list[bytes]:
        """``packed`` for each word by its key."""
        distinct = list(dict.fromkeys(words))
        word = np.fromiter(map(dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__, words), np.int64, len(words))
        like, mask = self._like(distinct, word, key)
        plain = np.array([len(w) <= LONG and not w.startswith("  ") and self.chars.issuperset(w) for w in distinct])
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        out: list = [None] * len(words)
        first = np.flatnonzero(like == np.arange(len(words)))
        untouched = first[mask[first] == 0]
        for i in untouched.tolist():
            out[i] = self.known[words[i]].whole
        first = first[mask[first] != 0]
        easy = first[plain[word[first]]]
        easy = easy[np.argsort(sizes[word[easy]], kind="stable")]
        for at in range(0, len(easy), 4096):
            some = easy[at : at + 4096].tolist()
            for i, made in zip(some, self._many([words[i] for i in some], key[some]), strict=True):
                out[i] = made
        for i in first[~plain[word[first]]].tolist():
            out[i] = self.packed(words[i], int(key[i]))
        return [out[i] for i in like.tolist()]

    def keys(self, text: str, n: int) -> np.ndarray:
        """The keys of the ``n`` words of a text."""
        first = np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed))
        x = (first + np.arange(n, dtype=np.uint64) * np.uint64(_START)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)

    def encode_all(self, docs: list[str]) -> list[bytes]:
        """Ids of each text's pieces, packed little-endian in self.kind."""
        out, at = [], 0
        while at < len(docs):  # as many texts as are segmented together
            words, keys, ends = [], [], []
            while at < len(docs) and (not ends or len(words) < BATCH_WORDS):
                own = WORDS.findall(" " + docs[at]) if docs[at] else []
                words += own
                keys.append(self.keys(docs[at], len(own)))
                ends.append(len(words))
                at += 1
            parts = self._segmented(words, np.concatenate(keys)) if words else []
            out += [b"".join(parts[begin:end]) for begin, end in zip([0, *ends], ends, strict=False)]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """Texts of packed pieces."""

    def __init__(self, pieces: list[bytes]):
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the text; the space that encoding put before it is taken off."""
        ids = np.frombuffer(packed, dtype=self.kind)
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = self.flat[np.repeat(self.starts[ids], sizes) + inside].tobytes()
        return text[1:] if text[:1] == b" " else text


def encode(documents: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model_path: str | None = None) -> DataFrame:
    """``documents(doc_id, text)`` as (doc_id, n_tokens, tokens): ids packed little-endian,
    two bytes each (four for vocabularies of over 65,536 pieces)."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))  # of fixed size
    made: list[Encoder] = []

    def step(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Encoder(vocabulary.value, dropout, seed))
        packed = made[0].encode_all([t.decode("utf-8", "surrogatepass") for t in texts(batch)])
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(p) // made[0].kind.itemsize for p in packed], "tokens": packed}

    return map_arrow(documents.select("doc_id", "text"), "doc_id long, n_tokens long, tokens binary", step)


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """Adds ``decoded`` (UTF-8) to ``encoded(doc_id, n_tokens, tokens)``."""
    pieces = _broadcast_pieces(encoded, model_path)
    made: list[Decoder] = []

    def step(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Decoder(pieces.value))
        own = [made[0].decode(x or b"") for x in batch.column("tokens").to_pylist()]
        return {c: batch.column(c) for c in ("doc_id", "n_tokens", "tokens")} | {"decoded": own}

    return map_arrow(encoded.select("doc_id", "n_tokens", "tokens"), "doc_id long, n_tokens long, tokens binary, decoded binary", step, column="tokens")


def _broadcast_pieces(df: DataFrame, model_path: str | None):
    return df.sparkSession.sparkContext.broadcast(load_vocabulary(model_path).pieces)


def encode_and_check(documents: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model_path: str | None = None) -> DataFrame:
    """``encode`` with the bytes and crc32 of each text and of what its pieces decode to:
    (doc_id, n_tokens, tokens, text_bytes, text_crc32, decoded_bytes, decoded_crc32)."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))  # of fixed size
    made: list = []

    def step(batch: pa.RecordBatch) -> dict:
        if not made:
            made.extend((Encoder(vocabulary.value, dropout, seed), Decoder(vocabulary.value.pieces)))
        encoder, decoder = made
        raw = texts(batch)
        packed = encoder.encode_all([t.decode("utf-8", "surrogatepass") for t in raw])
        back = [decoder.decode(p) for p in packed]
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(p) // encoder.kind.itemsize for p in packed],
            "tokens": packed,
            "text_bytes": [len(t) for t in raw],
            "text_crc32": [zlib.crc32(t) for t in raw],
            "decoded_bytes": [len(t) for t in back],
            "decoded_crc32": [zlib.crc32(t) for t in back],
        }

    schema = "doc_id long, n_tokens long, tokens binary, text_bytes long, text_crc32 long, decoded_bytes long, decoded_crc32 long"
    return map_arrow(documents.select("doc_id", "text"), schema, step)


def op2_merge_dropout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, decoded again; text_crc32 is that of the stored text."""
    return encode_and_check(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
