"""Quality by compression: how much better a text compresses after good texts than after bad.

Two zstandard dictionaries are built from labelled good and bad texts. A whole text is cut into
chunks of about CHUNK bytes, small enough that the dictionary and not the text itself is what
the compressor refers to; each chunk is compressed with either. The difference of the sizes per
byte, averaged over the text, becomes a probability by a logistic fit on texts that are in
neither dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewmill.llm.labels import logistic, training_texts
from reviewmill.llm.words import batches_of, freeing, texts_of

CHUNK = 512
DICTIONARY_BYTES = 1 << 18
SAMPLE_BYTES = 1 << 14
LEVEL = 3
PER_CLASS = 3000
FITTED_BYTES = 64 << 20


@dataclass
class Compression:
    """Two dictionaries and the logistic curve over the size difference."""

    good: bytes
    bad: bytes
    slope: float
    bias: float

    def probability(self, difference: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * difference + self.bias))))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves, cut
    into chunks of CHUNK bytes that are taken in a seeded order while they fit."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        chunks = [text[i : i + CHUNK] for text in samples for i in range(0, len(text), CHUNK)]
        order = np.random.default_rng(204).permutation(len(chunks))[: DICTIONARY_BYTES // CHUNK]
        return b"\n".join(chunks[i] for i in np.sort(order))[:DICTIONARY_BYTES]


def _samples(texts: DataFrame) -> pa.Table:
    """``y, sample`` on the driver: the texts in pieces of SAMPLE_BYTES. Of more than FITTED_BYTES
    a seeded share of the pieces of all texts is taken."""
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    share = min(1.0, FITTED_BYTES / max(total, 1))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, marks, samples = [], [], [], []
            for key, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), texts_of(batch.column("text")), strict=True):
                for i in range(0, len(text), SAMPLE_BYTES):
                    if share == 1 or xxhash.xxh3_64_intdigest(f"{key}/{i}", seed=205) < share * 2**64:
                        keys.append(key)
                        at.append(i)
                        marks.append(y)
                        samples.append(text[i : i + SAMPLE_BYTES])
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(at, pa.int64()), pa.array(marks, pa.int32()), pa.array(samples, pa.binary())], names=["doc_id", "at", "y", "sample"])

    pieces = texts.select("doc_id", "y", "text").mapInArrow(freeing(cut), "doc_id long, at long, y int, sample binary")
    return pieces.orderBy("doc_id", "at").select("y", "sample").toArrow()


class Sizes:
    """Size differences of whole texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for data in (good, bad):
            held = zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None
            if held:
                held.precompute_compress(level=LEVEL)
            self.both.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def difference(self, text: bytes) -> float:
        """Bytes saved by the good dictionary over the bad one, per byte, averaged over chunks."""
        if not text:
            return 0.0
        step = -(-len(text) // max(1, round(len(text) / CHUNK)))
        good, bad = self.both
        parts = [text[i : i + step] for i in range(0, len(text), step)]
        return sum((len(bad.compress(p)) - len(good.compress(p))) / len(p) for p in parts) / len(parts)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Compression:
    """Fit on at most ``per_class`` whole labelled texts of each class outside the held-out fold:
    two thirds of them make the dictionaries, the others the curve.

    The dictionaries are trained on the driver, from FITTED_BYTES of the sample at most; the
    curve's texts are compressed in tasks. With one class, or none, all scores are the smoothed
    share of class 1.
    """
    sample, counts = training_texts(docs, labels, label, per_class, seed=202)
    prior = math.log((counts[1] + 1) / (counts[0] + 1))
    if not counts[0] or not counts[1]:
        return Compression(b"", b"", 0.0, prior)
    third = F.pmod(F.xxhash64(F.lit(203), "doc_id"), F.lit(3))
    table = _samples(sample.where(third != 0))
    y, texts = table.column("y").to_pylist(), table.column("sample").to_pylist()
    good, bad = (dictionary([t for t, k in zip(texts, y, strict=True) if k == one]) for one in (1, 0))

    def differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            found = [sizes.difference(text) for text in texts_of(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.float64())], names=["doc_id", "y", "x"])

    rows = sample.where(third == 0).select("doc_id", "y", "text").mapInArrow(freeing(differences), "doc_id long, y int, x double").orderBy("doc_id").toArrow()
    x, z = np.array(rows.column("x").to_pylist(), float), np.array(rows.column("y").to_pylist(), float)
    if len(set(z.tolist())) < 2:
        return Compression(good, bad, 0.0, prior)
    share = np.where(z == 1, counts[1] / z.sum(), counts[0] / (len(z) - z.sum()))  # undoes the balancing
    slope, bias = logistic(x, z, share * len(z) / share.sum())
    return Compression(good, bad, slope, bias)


def score_quality(docs: DataFrame, model: Compression) -> DataFrame:
    """``docs`` with the column ``quality_score`` (0 to 1) of every whole text; null and empty texts
    have the score of no difference. Other columns are kept; one of that name is replaced."""
    kept = [c for c in docs.columns if c != "quality_score"]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m.good, m.bad)
        for batch, texts in batches_of(batches, "text"):
            scores = pa.array([m.probability(sizes.difference(text)) for text in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*kept, "quality_score"])

    return plain.mapInArrow(freeing(scored), StructType([*plain.schema]).add("quality_score", "double"))
