"""Byte-level BPE against the library, and back to the same bytes."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from reviewmill.llm import byte_bpe
from reviewmill.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [
    None,
    "",
    "  a  b\n\n c ",
    "it's DON'T we'll 12ab3 ½ ³",
    "\x1c\x1da b　c\u0085",
    "한글 각 ก็ 👩‍👩‍👧 ﻿hi <|endoftext|>",
    "new letters ౜࢏ 1\U00011de0 2 \U00010940x",
    "x" * 5000 + "ab" * 3000 + "é" * 500,
    " " * 3000 + "x" + "\n" * 300,
    "word " * 300_000,
    "word " * 3,
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(seed, n):
    rng = random.Random(seed)
    kinds = [lambda: chr(rng.randrange(97, 103)), lambda: chr(rng.randrange(32, 127)), lambda: chr(rng.randrange(0x80, 0x3000)), lambda: chr(rng.randrange(0xE000, 0x110000)), lambda: rng.choice(" \n\t'")]
    return ["".join(rng.choice(kinds)() for _ in range(rng.randrange(0, 400))) for _ in range(n)]


def test_ids_are_those_of_the_library(spark, library):
    texts = ODD + random_texts(1, 60)
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)] + [(None, "no id", None, b"x"), (3, "same id", None, b"y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids binary").repartition(3)
    coded = byte_bpe.encode(docs, PATH, PATTERN)
    assert coded.columns == ["doc_id", "decoded", "ids"]
    back = byte_bpe.decode(coded, PATH, PATTERN).collect()
    got = sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in back)
    want = [(str(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _, _ in rows]
    assert got == sorted(want)


def test_tables_are_bounded_and_segments_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TABLE_BYTES", 2000)
    monkeypatch.setattr(byte_bpe, "SEGMENT_CHARS", 30)
    monkeypatch.setattr(byte_bpe, "MATRIX_CELLS", 64)
    pieces = byte_bpe.Pieces(byte_bpe.vocabulary(PATH, PATTERN))
    for text in random_texts(2, 80) + ODD[1:9]:
        assert pieces.encode([text])[0].tolist() == library.encode_ordinary(text)
        assert len(pieces) < 8000


def test_rows_and_heap_merge_alike():
    known = byte_bpe.vocabulary(PATH, PATTERN)
    rng = random.Random(3)
    pieces = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(2, 129))) for _ in range(300)]
    by_rows = known.encode_pieces(pieces)
    known.encode_pieces([b"q" * 200])  # fills the table of pairs
    for piece, ids in zip(pieces, by_rows, strict=True):
        by_heap = byte_bpe.merge_long(known.single[np.frombuffer(piece, np.uint8)].tolist(), known.by_pair)
        assert ids.tolist() == ([known.ranks[piece]] if piece in known.ranks else by_heap)


def test_pair_table():
    rng = np.random.default_rng(4)
    left, right = rng.integers(0, 300, 5000), rng.integers(0, 300, 5000)
    pairs = dict.fromkeys(zip(left.tolist(), right.tolist(), strict=True))
    for n, pair in enumerate(pairs):
        pairs[pair] = n
    known = byte_bpe.PairTable(*np.array(list(pairs)).T, np.arange(len(pairs)))
    a, b = rng.integers(-1, 300, (50, 40)), rng.integers(-1, 300, (50, 40))
    want = [[pairs.get((x, y), byte_bpe.NO_PAIR) for x, y in zip(r, s, strict=True)] for r, s in zip(a.tolist(), b.tolist(), strict=True)]
    assert known.find(a, b).tolist() == want


def test_nothing_and_null_ids(spark):
    empty = byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN)
    assert byte_bpe.decode(empty, PATH, PATTERN).collect() == []
    held = byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH, PATTERN).first()
    assert held["decoded"] is None


def test_query(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD[:7])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    for r in QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect():
        ids = library.encode_ordinary(ODD[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((ODD[r["doc_id"]] or "").encode()).hexdigest()
