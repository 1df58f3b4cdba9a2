"""Runs: maximal stretches of words that repeat with a period, such as a sentence in a loop.

A suffix automaton takes a text word by word. Its suffix links form a tree, kept as a link-cut
tree whose solid paths are the states that last occurred at one and the same end. Appending a
word accesses the new state: each solid path on the way to the root is a set of suffixes that
last ended at one place, and is recoloured with the new end. If the distance of both ends is no
more than the longest of these suffixes, the suffix and its copy before form a square, and its
start cannot be moved left: a longer suffix would lie on the same path. A square extended to the
right is a run, and its distance is its smallest period.

Words that no run can hold are put aside first: all groups of GROUP words within a run come
again within it, but for at most GROUP - 1 amid a run of just two periods. Only stretches where
that is so reach the automaton, each by itself.

A text is worked on by one task. Beside it, a stretch takes about 100 bytes a word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from reviewmill.llm.words import batches_of, bound_batches, freeing

GROUP = 4
RUN = StructType().add("start", "long").add("length", "long").add("period", "long")


class LastEnds:
    """The suffix automaton of a growing word sequence and, per state, where it last ended.

    State 0 is no state, 1 the root. ``up`` is the splay parent within a solid path, or the
    link from a path's top to the path above; ``end`` is the colour of a path, at its splay root.
    Each state's first transition is in arrays, others are in ``more``.
    """

    def __init__(self, words: int):
        size = 2 * words + 3
        self.length, self.link = array("i", bytes(4 * size)), array("i", bytes(4 * size))
        self.word, self.to = array("i", [-1]) * size, array("i", bytes(4 * size))
        self.more: dict[int, dict[int, int]] = {}
        self.up, self.left, self.right = (array("i", bytes(4 * size)) for _ in range(3))
        self.end = array("i", [-1]) * size
        self.states, self.last, self.words = 2, 1, 0

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        held = self.more.get(state)
        return held.get(word, 0) if held else 0

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its solid path's splay tree; the path's colour moves along."""
        up, left, right, end = self.up, self.left, self.right, self.end
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if not inner:
                end[x] = end[p]
                self._rotate(x, p)
                return
            if (left[g] == p) == (left[p] == x):
                self._rotate(p, g)
                self._rotate(x, p)
            else:
                self._rotate(x, p)
                self._rotate(x, g)
            end[x] = end[g]

    def _rotate(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            up[child] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _extend(self, word: int) -> int:
        """Append a word to the automaton; the new state hangs below its suffix link."""
        length, link, up = self.length, self.link, self.up
        new, self.states = self.states, self.states + 1
        length[new] = length[self.last] + 1
        p = self.last
        while p and not self._next(p, word):
            self._set(p, word, new)
            p = link[p]
        if not p:
            suffix = 1
        else:
            suffix = self._next(p, word)
            if length[suffix] != length[p] + 1:
                suffix = self._split(p, word, suffix)
        link[new] = up[new] = suffix
        self.last = new
        return new

    def _split(self, p: int, word: int, state: int) -> int:
        """A state for the shorter suffixes of ``state``, put right above it on its solid path."""
        upper, self.states = self.states, self.states + 1
        self.length[upper] = self.length[p] + 1
        self.word[upper], self.to[upper] = self.word[state], self.to[state]
        if state in self.more:
            self.more[upper] = dict(self.more[state])
        self._splay(state)
        above = self.left[upper] = self.left[state]
        if above:
            self.up[above] = upper
        self.left[state], self.up[upper] = upper, state
        self.link[upper], self.link[state] = self.link[state], upper
        while p and self._next(p, word) == state:
            self._set(p, word, upper)
            p = self.link[p]
        return upper

    def append(self, word: int) -> list[tuple[int, int]]:
        """(distance, longest suffix) for each square that ends with ``word``, the distance
        being that to the suffix's last end before."""
        now = self.words
        self.words += 1
        x, below, squares = self._extend(word), 0, []
        up, right, end, length = self.up, self.right, self.end, self.length
        while x:
            self._splay(x)
            before = end[x]
            if before >= 0 and now - before <= length[x]:
                squares.append((now - before, length[x]))
            cut = right[x]
            if cut:
                end[cut] = before
            right[x] = below
            below, x = x, up[x]
        end[below] = now
        return squares


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least two periods, by start, then period."""
    known, out, reached = LastEnds(len(words)), [], {}
    n = len(words)
    for i, word in enumerate(words):
        for period, suffix in known.append(word):
            if reached.get(period, -1) >= i:
                continue  # the run found before goes on
            stop = i + 1
            while stop < n and words[stop] == words[stop - period]:
                stop += 1
            start = i - period - suffix + 1
            reached[period] = stop - 1
            out.append((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where a run of at least ``least`` words may lie: (first, stop) of stretches whose groups
    of GROUP words come again in the stretch, with gaps of at most GROUP - 1 groups."""
    todo, out = [(0, len(ids))], []
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        part = ids[low:high]
        _, part = np.unique(part, return_inverse=True)
        mixed = np.zeros(len(part) - GROUP + 1, np.uint64)
        for k in range(GROUP):  # equal groups are equal here; others may be, which only keeps more
            mixed = (mixed ^ part[k : len(part) - GROUP + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        _, at, n = np.unique(mixed, return_inverse=True, return_counts=True)
        again = np.flatnonzero(n[at] > 1)
        if not len(again):
            continue
        cuts = np.flatnonzero(np.diff(again) > GROUP)
        firsts, lasts = again[np.append(0, cuts + 1)], again[np.append(cuts, len(again) - 1)] + GROUP
        found = [(low + int(a), low + int(b)) for a, b in zip(firsts, lasts, strict=True)]
        if found == [(low, high)]:
            out.append((low, high))
        else:
            todo += found
    return sorted(out)


@dataclass(frozen=True)
class Limits:
    """A run counts from ``least`` words and two periods on; up to ``GROUP`` + 3 words short
    stretches could not be told by their groups."""

    least: int = 12

    def __post_init__(self) -> None:
        if self.least < 2 * GROUP:
            raise ValueError(f"runs are found from {2 * GROUP} words on")


def find_runs(words: list, limits: Limits = Limits()) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a word list, by start, then period."""
    if len(words) < limits.least:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    out = []
    for low, high in _stretches(ids, limits.least):
        found = runs_of(ids[low:high].tolist())
        out += [(low + s, n, q) for s, n, q in found if n >= limits.least]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        words = [words[i] for i in kept.tolist()]
    return b" ".join(words)


def detect(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed``, for each text.

    Words are longest runs of other than space and U+0009 to U+000D, numbered from 0. A run is a
    stretch of at least ``least`` words and two of its smallest period that no neighbouring word
    extends. ``collapsed`` is the text without the words that a run holds after its first period,
    joined by single spaces. ``text`` is replaced; other columns are kept, those of the new
    names are replaced. A null or empty text has no words and no runs, and an empty ``collapsed``. Rows
    are returned as often as they come; an empty table gives an empty one.
    """
    new, limits = ("n_words", "runs", "collapsed"), Limits(least)
    kept = [c for c in docs.columns if c not in (text, *new)]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("collapsed"))
    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(batches, "collapsed"):
            counts, runs, rest = [], [], []
            for whole in texts:
                words = whole.split()
                mine = find_runs(words, limits)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
                rest.append(collapsed(words, mine).decode())
            arrays = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])

    schema = StructType([*plain.schema][:-1]).add("n_words", "long").add("runs", ArrayType(RUN)).add("collapsed", "string")
    return bound_batches(plain).mapInArrow(freeing(found), schema)
