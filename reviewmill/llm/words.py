"""Words of whole texts as numbers, computed once per distinct word and Python worker.

A word is a longest run of bytes other than space and U+0009 to U+000D, which is what
``bytes.split`` yields; ``bytes.lower`` changes A-Z alone.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SEGMENT_BYTES = 1 << 20
TABLE_BYTES = 48 << 20
WORD_BYTES = 170  # what a word costs in a table besides its letters and its value
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def segments(text: bytes) -> Iterator[bytes]:
    """A text cut between words into pieces of about a megabyte, so that the list of its
    words never has to be held for a whole very long text."""
    start = 0
    while len(text) - start > SEGMENT_BYTES:
        gap = _SPACE.search(text, start + SEGMENT_BYTES)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.end()
    yield text[start:] if start else text


class WordValues(dict):
    """One value per distinct word, computed for the new words of a batch together.

    ``compute`` gets new words and returns one array row for each. The table is emptied at
    ``limit`` bytes, so its memory is bounded whatever the vocabulary; it goes with its task.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = TABLE_BYTES):
        super().__init__()
        self.compute, self.limit, self.cost = compute, limit, 0
        self.fresh: list[bytes] = []
        self.values: np.ndarray | None = None
        self.used = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def _settle(self) -> None:
        if not self.fresh:
            return
        new = self.compute(self.fresh)
        self.cost += 2 * new.nbytes + sum(map(len, self.fresh)) + WORD_BYTES * len(self.fresh)
        if self.values is None or self.used + len(new) > len(self.values):
            grown = np.empty((max(4096, 2 * (self.used + len(new))), *new.shape[1:]), new.dtype)
            if self.values is not None:
                grown[: self.used] = self.values[: self.used]
            self.values = grown
        self.values[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.fresh = []

    def of(self, words: list[bytes]) -> np.ndarray:
        """The values of ``words``, in their order."""
        if self.cost > self.limit:
            self.clear()
            self.used, self.cost, self.values = 0, 0, None
        numbers = self.numbers(words)
        self._settle()
        if self.values is None:
            return self.compute([])
        return self.values[numbers]


def batches_of(batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``size`` bytes of text each, and their texts."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            part = batch.slice(start, stop - start)
            yield part, texts_of(part.column(column))
            start = stop


def bound_batches(docs: DataFrame, rows: int = 1024) -> DataFrame:
    """``docs``, whose whole texts are about to go to Python: unless the session sets a number of
    its own, an Arrow batch holds ``rows`` of them instead of Spark's 10,000, in the JVM and in the
    worker."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, rows)
    return docs


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def free_memory() -> None:
    """Hand memory that is no longer in use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def freeing(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, after which its worker, which Spark keeps for later tasks, hands the memory of
    the task's tables back to the system."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        free_memory()

    return run
