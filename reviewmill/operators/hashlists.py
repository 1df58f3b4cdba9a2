"""Lists of term hashes as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def entries_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of several lists, one list after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def part_of(terms: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash (unsigned): parts are ranges of hashes."""
    return ((terms >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def counted(doc: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of terms (unsigned hashes) and their documents, ascending: the distinct terms, ascending, how
    many documents each has, these, and how often they hold the term."""
    order = np.argsort(terms, kind="stable")
    terms, doc = terms[order], doc[order]
    first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])][: len(terms)])
    tf = np.diff(np.r_[first, len(terms)])
    terms, doc = terms[first], doc[first]
    start = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]][: len(terms)])
    return terms[start], np.diff(np.r_[start, len(terms)]), doc, tf


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of lists with about ``most`` entries in total."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi
