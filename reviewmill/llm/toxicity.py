"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words without the marks around them, in lower case, and
their first letters, so that inflected words share terms. The machine adds a weight per term
and, for every pair of terms, the product of their factors: what is harmless alone may weigh
together. Pairs cost no more than terms, as the sum over pairs is half of the squared sum less
the summed squares.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewmill.llm.labels import logistic, training_texts
from reviewmill.llm.words import WordValues, batches_of, bound_batches, free_memory, freeing, segments, sliced, texts_of
from reviewmill.session import cut_lineage

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
LEAST_DOCS = 4
FREQUENT = 0.01
SIGNIFICANT = 10.83  # chi-square of one degree of freedom, one in a thousand
FACTORS = 8
PER_CLASS = 4000
_MARKS = string.punctuation + "«»“”‘’¿¡…–—"


def term_buckets(words: list[bytes]) -> np.ndarray:
    """The buckets of the terms of each word, -1 where there is none."""
    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int32)
    for i, word in enumerate(words):
        term = word.decode("utf-8", "replace").strip(_MARKS).lower()
        if term:
            out[i, 0] = xxhash.xxh3_64_intdigest(term) % BUCKETS
            for j, n in enumerate(PREFIXES, 1):
                if len(term) > n:
                    out[i, j] = xxhash.xxh3_64_intdigest(f"{term[:n]}\x00") % BUCKETS
    return out


class Terms:
    """The distinct buckets of whole texts."""

    def __init__(self) -> None:
        self.words = WordValues(term_buckets)

    def of(self, text: bytes) -> np.ndarray:
        found = [np.unique(self.words.of(segment.split())) for segment in segments(text)]
        buckets = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        return buckets[buckets >= 0]


@dataclass
class Machine:
    """Weights and factors of the terms that were kept; ``row`` maps a bucket to its term, and
    buckets without one to the last row, which is zero. ``slope`` and ``shift`` calibrate."""

    row: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slope: float
    shift: float
    share: float

    def raw(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[rows].sum()) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, buckets: np.ndarray) -> float:
        rows = self.row[buckets]
        rows = rows[rows < len(self.weights) - 1]
        if not len(rows):
            return self.share
        raw = self.raw(rows)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * raw + self.shift))))


def choose_terms(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets that can tell something: in at least LEAST_DOCS texts, and either frequent (in
    FREQUENT of the texts), whatever they tell by themselves, as pairs of such terms may decide, or
    unevenly spread over the labels (likelihood ratio above SIGNIFICANT). Rare terms whose spread
    is what chance gives are left out; there is no limit to the number of terms."""
    buckets, column = np.unique(np.concatenate([*sets, np.empty(0, np.int32)]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n1 = np.bincount(column, weights=y[owner], minlength=len(buckets))
    n = np.bincount(column, minlength=len(buckets))
    total, positive = len(y), y.sum()
    ratio = np.zeros(len(buckets))
    for held, marked, base in ((n, n1, positive), (n, n - n1, total - positive)):
        for joint, margin in ((marked, held), (base - marked, total - held)):
            with np.errstate(divide="ignore", invalid="ignore"):
                part = 2 * joint * np.log(joint * total / (margin * base))
            ratio += np.where(joint > 0, part, 0)
    return buckets[(n >= LEAST_DOCS) & ((ratio > SIGNIFICANT) | (n >= FREQUENT * total))]


class _Batch:
    """Documents trained on together: their terms, and where equal terms lie."""

    def __init__(self, data: list[np.ndarray]):
        self.ids = np.concatenate(data)
        self.lengths = np.array([len(d) for d in data])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.order = np.argsort(self.ids, kind="stable")
        ordered = self.ids[self.order]
        self.firsts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        self.used = ordered[self.firsts]


def _train(data: list[np.ndarray], y: np.ndarray, m: int, seed: int, epochs: int, rate: float, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad. Row ``m`` closes every document and stays zero."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m + 1, np.float32), rng.normal(0, 0.01, (m + 1, FACTORS)).astype(np.float32)
    v[m] = 0
    bias, bias_sum = 0.0, 1e-8
    w_sum, v_sum = np.full(m + 1, 1e-8, np.float32), np.full(v.shape, 1e-8, np.float32)
    order = rng.permutation(len(data))
    groups = [order[start : start + 64] for start in range(0, len(order), 64)]
    batches = [(_Batch([data[i] for i in g]), y[g]) for g in groups]
    for _ in range(epochs):
        for at in rng.permutation(len(batches)):
            b, marks = batches[at]
            vi = v.take(b.ids, axis=0)
            total = np.add.reduceat(vi, b.starts)
            raw = bias + np.add.reduceat(w.take(b.ids), b.starts) + 0.5 * (np.einsum("ij,ij->i", total, total) - np.add.reduceat(np.einsum("ij,ij->i", vi, vi), b.starts))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - marks).astype(np.float32)
            each = np.repeat(error / np.float32(len(marks)), b.lengths)
            pull = each[:, None] * (np.repeat(total, b.lengths, axis=0) - vi)
            wu, vu = w.take(b.used), v.take(b.used, axis=0)
            gw = np.add.reduceat(each.take(b.order), b.firsts) + decay * wu
            gv = np.add.reduceat(pull.take(b.order, axis=0), b.firsts) + decay * vu
            ws, vs = w_sum.take(b.used) + gw * gw, v_sum.take(b.used, axis=0) + gv * gv
            w_sum[b.used], v_sum[b.used] = ws, vs
            w[b.used], v[b.used] = wu - rate * gw / np.sqrt(ws), vu - rate * 0.2 * gv / np.sqrt(vs)
            w[m], v[m] = 0, 0
            gb = float(error.mean())
            bias_sum += gb**2
            bias -= rate * gb / math.sqrt(bias_sum)
    return bias, w, v


def fit_machine(sets: list[np.ndarray], y: np.ndarray, shares: tuple[int, int], seed: int = 5, epochs: int = 15, rate: float = 0.1, decay: float = 3e-3) -> Machine:
    """Fit on term sets and labels. Machines that saw two thirds of the texts say, on the last
    third, which curve turns raw values into probabilities. With one class, or none, the score
    is the smoothed share of class 1 (``shares`` are the class counts)."""
    kept = choose_terms(sets, y) if len(set(y.tolist())) == 2 else np.empty(0, np.int32)
    m = len(kept)
    row = np.full(BUCKETS, m, np.int32)
    row[kept] = np.arange(m)
    machine = Machine(row, 0.0, np.zeros(m + 1), np.zeros((m + 1, FACTORS)), 1.0, 0.0, (shares[1] + 0.5) / (sum(shares) + 2))  # without any label below one half
    if not m:
        return machine
    data = [np.append(r[r < m], m) for r in (row[s] for s in sets)]
    part = np.random.default_rng(seed).permutation(len(data)) % 3
    raw = np.zeros(len(data))
    for k in range(3):
        train, rest = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(y[train].tolist())) == 2:
            machine.bias, machine.weights, machine.factors = _train([data[i] for i in train], y[train], m, seed, epochs, rate, decay)
            raw[rest] = [machine.raw(data[i]) for i in rest]
    machine.bias, machine.weights, machine.factors = _train(data, y, m, seed, epochs, rate, decay)
    machine.slope, machine.shift = logistic(raw, y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y))
    return machine


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Machine:
    """Fit on at most ``per_class`` whole labelled texts of each class outside the held-out fold.

    Tasks turn texts into term sets; only these, of the bounded sample, reach the driver.
    """
    sample, counts = training_texts(docs, labels, label, per_class, seed=101)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in sliced(batches):
            found = [terms.of(text).tolist() for text in texts_of(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "terms"])

    rows = cut_lineage(bound_batches(sample).select("doc_id", "y", "text").mapInArrow(freeing(sets), "doc_id long, y int, terms array<int>"), "toxic-terms")
    table = rows.orderBy("doc_id").toArrow()
    lists = table.column("terms").combine_chunks()
    ends, buckets = np.cumsum(lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    y = table.column("y").to_numpy().astype(float)
    machine = fit_machine(np.split(buckets, ends[:-1]) if len(ends) else [], y, (counts[0], counts[1]))
    free_memory()
    return machine


def score_toxicity(docs: DataFrame, machine: Machine, column: str = "toxicity") -> DataFrame:
    """``docs`` with ``column`` (0 to 1), the score of every whole text; null and empty texts have
    the score of no terms. Other columns are kept; one of that name is replaced."""
    kept = [c for c in docs.columns if c != column]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    model = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by BUCKETS

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), model.value
        for batch, texts in batches_of(batches, "text"):
            scores = pa.array([m.score(terms.of(text)) for text in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*kept, column])

    return bound_batches(plain).mapInArrow(freeing(scored), StructType([*plain.schema]).add(column, "double"))
