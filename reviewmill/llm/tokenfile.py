"""Token ids in a fixed-width bit-packed file format.

A file is a row group of blocks. A block holds whole documents: their ids one after the
other, each in ``bits`` bits (the fewest that hold the vocabulary), little end first, without
gaps. Beside the packed bytes stand the documents' ids and, per document, the offset of its
first token in the block, so any document or range of tokens is read without its neighbours.
The container is Parquet: written by Spark's committer, it exists whole or not at all, lies
on any file system Spark writes to, and is found by ``doc_id`` through its statistics.

Order: ascending ``doc_id``, null first; rows of one ``doc_id`` by a hash of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.llm.encoding import encoder
from reviewmill.llm.words import batches_of, bound_batches, freeing

BLOCK_TOKENS = 1 << 16
BLOCKS = "shard int, block int, bits int, n_tokens long, doc_ids array<long>, firsts array<long>, packed binary"


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, little end first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for start in range(0, len(ids), 1 << 16):  # 65536 ids fill whole bytes at any width
        part = np.ascontiguousarray(ids[start : start + (1 << 16)], "<u4")
        rows = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(rows, bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of packed bytes; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    out = []
    for at in range(start, start + count, 1 << 16):
        n = min(1 << 16, start + count - at)
        first = at * bits
        held = np.frombuffer(packed, np.uint8, (first + n * bits + 7) // 8 - first // 8, first // 8)
        flat = np.unpackbits(held, bitorder="little")[first % 8 : first % 8 + n * bits]
        rows = np.zeros((n, 32), np.uint8)
        rows[:, :bits] = flat.reshape(n, bits)
        out.append(np.packbits(rows, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, files: int) -> None:
    """Write the ids of every whole text, each document closed by ``end``, as ``files`` files.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null and empty texts are
    documents of the end id alone. Rows that share a ``doc_id``, null included, are spread by
    their text. The texts are dealt by range, so that ids never shuffle.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, shard = encoder(tokenizer), TaskContext.get().partitionId()
        bits = width(max(known.vocabulary, end + 1))
        names = [field.split()[0] for field in BLOCKS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def row(number: int, keys: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            firsts = np.cumsum([0] + [len(p) for p in parts])
            values = (shard, number, bits, int(firsts[-1]), keys, firsts[:-1].tolist(), pack(np.concatenate(parts), bits))
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        number, held, keys, parts = 0, 0, [], []
        for batch, texts in batches_of(batches, "text"):
            for key, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                keys.append(key)
                parts.append(known.with_end(text, end))
                held += len(parts[-1])
                if held >= BLOCK_TOKENS:
                    yield row(number, keys, parts)
                    number, held, keys, parts = number + 1, 0, [], []
        if keys:
            yield row(number, keys, parts)

    spread = bound_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(files, "doc_id", "_tie")
    ordered = spread.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    ordered.mapInArrow(freeing(blocks), BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a written file."""
    return spark.read.schema(BLOCKS).parquet(path)


def document_tokens(blocks: DataFrame) -> DataFrame:
    """One row per document: ``doc_id`` and its ids, unpacked from its own bytes only."""

    def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, _, _, _ in _documents(batches):
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(freeing(unpacked), "doc_id long, ids array<long>")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], list[int], int, int]]:
    for batch in batches:
        for row in batch.to_pylist():
            firsts = [*row["firsts"], row["n_tokens"]]
            ids = [unpack(row["packed"], row["bits"], a, b - a) for a, b in zip(firsts, firsts[1:])]
            yield row["doc_ids"], ids, firsts[:-1], row["shard"], row["block"]


def document_digests(blocks: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts all ids before it
    in the file's order. Only counts per block are summed up, no ids move."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, firsts, shard, block in _documents(batches):
            yield pa.record_batch(
                [
                    pa.array([shard] * len(keys), pa.int32()),
                    pa.array([block] * len(keys), pa.int32()),
                    pa.array(keys, pa.int64()),
                    pa.array(firsts, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                ],
                names=["shard", "block", "doc_id", "first", "n_tokens", "ids_crc32"],
            )

    counts = blocks.select("shard", "block", "n_tokens")
    shards = counts.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row per file, so that this window stays small; blocks are summed within their file
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard").orderBy("block")
    bases = counts.join(before, "shard").select(
        "shard", "block", (F.col("base") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("base")
    )
    rows = blocks.mapInArrow(freeing(digests), "shard int, block int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
