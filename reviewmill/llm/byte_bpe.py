"""Byte-level BPE: texts to token ids and back, by a table of ranks.

A text is cut by the tokenizer's pattern; each piece that is no token itself starts as its bytes,
and its leftmost pair of least rank is merged until no pair has a rank. Pieces that are new to a
task are merged together: padded matrices, one per bucket of lengths, in which every row merges
one pair a round. Pairs are looked up in an open-addressing hash table of numpy arrays; after a
round rows close up over the merged place, and finished rows leave the matrix. A piece longer
than the widest matrix is merged by itself with a heap, in the same order.

Pieces are kept with their ids up to TABLE_BYTES in a task, and go with it.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewmill.llm.words import batches_of, bound_batches, freeing

WIDTHS = (4, 8, 16, 32, 64, 128)
MATRIX_CELLS = 1 << 20
SEGMENT_CHARS = 1 << 18
TABLE_BYTES = 64 << 20
PIECE_BYTES = 200  # what a piece costs in the tables besides its letters
NO_PAIR = np.int32(np.iinfo(np.int32).max)
_WIDTH_OF = [min(w for w in WIDTHS if w >= n) for n in range(WIDTHS[-1] + 1)]
_GAP = regex.compile(r"(?<=\S)\s")


class PairTable:
    """Rank of each pair of tokens that make a token: hashed, open addressing, linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(2 * len(rank)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_PAIR, np.int32)
        keys, values = self._key(left, right), np.asarray(rank, np.int32)
        slots, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            placed = self.keys[slots] == keys
            self.ranks[slots[placed]] = values[placed]
            keys, values = keys[~placed], values[~placed]
            slots = (slots[~placed] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_PAIR where there is none; tokens below 0 are padding."""
        out = np.full(left.shape, NO_PAIR, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left.reshape(-1)[open_], right.reshape(-1)[open_])
        slots, flat = self._slot(keys), out.reshape(-1)
        for _ in range(self.probes):
            if not len(open_):
                break
            there = self.keys[slots]
            hit = there == keys
            flat[open_[hit]] = self.ranks[slots[hit]]
            on = ~hit & (there != -1)
            open_, keys, slots = open_[on], keys[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out


def merge_rows(tokens: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Rows of tokens, padded with -1, after all merges: one merge per row and round."""
    done = np.full_like(tokens, -1)
    where = np.arange(len(tokens))
    ranks = pairs.find(tokens[:, :-1], tokens[:, 1:])
    while len(where):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(where), np.int64)
        best = ranks[np.arange(len(where)), at] if ranks.shape[1] else np.full(len(where), NO_PAIR)
        over = best == NO_PAIR
        if over.any():
            done[where[over], : tokens.shape[1]] = tokens[over]
            tokens, ranks, where, at, best = tokens[~over], ranks[~over], where[~over], at[~over], best[~over]
            if not len(where):
                break
        rows, columns = np.arange(len(where)), np.arange(tokens.shape[1] - 1)
        tokens[rows, at] = best
        closed = columns + (columns > at[:, None])
        tokens = np.take_along_axis(tokens, closed, axis=1)
        ranks = np.take_along_axis(ranks, closed[:, :-1], axis=1)
        if not ranks.shape[1]:
            continue
        for side in (at - 1, at):  # the two pairs that the new token is part of
            ok = (side >= 0) & (side < ranks.shape[1])
            r, c = rows[ok], side[ok]
            ranks[r, c] = pairs.find(tokens[r, c], tokens[r, c + 1])
    return done


def merge_long(tokens: list[int], rank: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for one long piece: a heap of (rank, place) over a linked list."""
    n = len(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((tokens[i], tokens[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if tokens[i] < 0 or j >= n or rank.get((tokens[i], tokens[j])) != r:
            continue
        tokens[i], tokens[j] = r, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (found := rank.get((tokens[a], tokens[b]))) is not None:
                heapq.heappush(heap, (found, a))
    return [t for t in tokens if t >= 0]


class Vocabulary:
    """Ranks of a file (a base64 token and its rank a line), pairs that merge, and the pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, file))}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        found = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)
        self.by_pair: dict[tuple[int, int], int] | None = None
        self.pattern, self.text_pattern = regex.compile(pattern), pattern
        self.newer: frozenset[str] | None = None
        self.beyond: re.Pattern | None = None
        self.older_pattern: regex.Pattern | None = None

    def _compare_classes(self) -> None:
        """Find letters and numbers of a Unicode version that the tokenizer's library does not
        have yet; texts with these are cut by a pattern that leaves them out."""
        plain = {bytes([i]): i for i in range(256)}
        every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
        left_out = {}
        for kind in ("L", "N"):
            mine = "".join(regex.findall(rf"\p{{{kind}}}+", every))
            theirs = tiktoken.Encoding("classes", pat_str=rf"\p{{{kind}}}+", mergeable_ranks=plain, special_tokens={})
            known = set(theirs.decode(theirs.encode_ordinary(mine)))
            left_out[kind] = [c for c in mine if c not in known]
        self.newer = frozenset(left_out["L"] + left_out["N"])
        self.beyond = re.compile(f"[{min(self.newer, default=chr(0x10FFFF))}-{chr(0x10FFFF)}]")
        self.older_pattern = self._set_differences(left_out)

    def _set_differences(self, left_out: dict[str, list[str]]) -> regex.Pattern:
        """The pattern with each class written as a set without the newer characters."""
        pattern = self.text_pattern
        sets = {k: rf"[\p{{{k}}}--[{''.join(v)}]]" if v else rf"\p{{{k}}}" for k, v in left_out.items()}
        negated = r"[^\s\p{L}\p{N}]"
        if negated in pattern:
            inside = rf"[^\s{sets['L']}{sets['N']}]"
            pattern = pattern.replace(negated, "\x00")
        else:
            inside = ""
        for kind, text in sets.items():
            pattern = pattern.replace(rf"\p{{{kind}}}", text)
        return regex.compile(pattern.replace("\x00", inside), regex.V1)

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            if self.newer is None:
                self._compare_classes()
            if self.beyond.search(text) and not self.newer.isdisjoint(set(text)):
                return self.older_pattern.findall(text)
        return self.pattern.findall(text)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) <= WIDTHS[-1]:
                buckets.setdefault(_WIDTH_OF[len(piece)], []).append(i)
            else:
                if self.by_pair is None:
                    keys, used = self.pairs.keys, self.pairs.keys != -1
                    self.by_pair = dict(zip(zip((keys[used] >> 32).tolist(), (keys[used] & 0xFFFFFFFF).tolist(), strict=True), self.pairs.ranks[used].tolist(), strict=True))
                out[i] = np.array(merge_long(self.single[np.frombuffer(piece, np.uint8)].tolist(), self.by_pair), np.int32)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for low in range(0, len(members), step):
                part = members[low : low + step]
                lengths = np.array([len(pieces[i]) for i in part])
                inside = np.arange(width) < lengths[:, None]
                tokens = np.full((len(part), width), -1, np.int32)
                tokens[inside] = self.single[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
                merged = merge_rows(tokens, self.pairs)
                for i, row, n in zip(part, merged, (merged >= 0).sum(axis=1), strict=True):
                    out[i] = row[:n]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The tables of a file; of fixed size, kept by the Python worker."""
    return Vocabulary(path, pattern)


def text_segments(text: str) -> Iterator[str]:
    """A text cut before white space that follows other characters, where pieces end anyway."""
    start = 0
    while len(text) - start > SEGMENT_CHARS:
        gap = _GAP.search(text, start + SEGMENT_CHARS)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:] if start else text


class Pieces(dict):
    """Numbers of the pieces of a task, and their ids one after the other."""

    def __init__(self, known: Vocabulary):
        super().__init__()
        self.known = known
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.ids, self.first, self.cost = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number

    def _settle(self) -> None:
        if not self.fresh:
            return
        coded = [piece.encode() for piece in self.fresh]
        new = self.known.encode_pieces(coded)
        self.cost += sum(PIECE_BYTES + 5 * len(c) for c in coded)
        lengths = np.array([len(n) for n in new])
        self.ids = np.concatenate([self.ids, *new])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        self.fresh = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts. New pieces of all of them are merged together."""
        if self.cost > TABLE_BYTES:
            self._forget()
        numbers = [[np.fromiter(map(self.__getitem__, found), np.int64, len(found)) for s in text_segments(text) for found in (self.known.pieces(s),)] for text in texts]
        self._settle()
        return [self._gather(np.concatenate(parts)) for parts in numbers]

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        first = self.first[numbers]
        lengths = self.first[numbers + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(first - ends + lengths, lengths) + np.arange(total)]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` with ``column``: the ids of every whole text, as little-endian 32-bit integers.

    ``text`` is replaced by ``column``; other columns are kept, one named ``column`` is replaced.
    A null text has the ids of an empty one: none. Rows are kept as they are, repeated ones and
    those with null in any other column too; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in (text, column)]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(column))

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary(path, pattern))
        for batch, texts in batches_of(batches, column):
            found = [ids.astype("<u4").tobytes() for ids in pieces.encode([t.decode() for t in texts])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*kept, column])

    return bound_batches(plain).mapInArrow(freeing(encoded), StructType([*plain.schema][:-1]).add(column, "binary"))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``rows`` with ``column``: the bytes that ``ids`` (little-endian 32-bit integers) stand for.

    Bytes, not text, as ids may be cut anywhere. Null ids are null bytes. Other columns are kept,
    one named ``column`` is replaced.
    """
    kept = [c for c in rows.columns if c != column]
    plain = rows.select(*[F.col(f"`{c}`") for c in kept])

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                held = part.column(ids).to_pylist()
                found = [None if x is None else known.decode(np.frombuffer(x, "<u4")) for x in held]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*kept, column])

    return plain.mapInArrow(freeing(decoded), StructType([*plain.schema]).add(column, "binary"))
