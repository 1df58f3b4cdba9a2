"""What a step holds at once is bounded, however long its lists are."""

import tracemalloc

import numpy as np
import pyarrow as pa

from reviewmill.operators import cellindex as C
from reviewmill.operators import embedding as E
from reviewmill.operators import postings as P
from reviewmill.operators import termsum as T
from reviewmill.session import spread


def lists(columns):
    return pa.array(columns, pa.list_(pa.int32())), pa.array([[0.5 + (i % 3) for i in c] for c in columns], pa.list_(pa.float32()))


def test_gram_of_rare_and_common_terms_needs_little_more_than_itself():
    n, rng = 400, np.random.default_rng(2)
    columns = [sorted(rng.choice(n, size, replace=False).tolist()) for size in [2, 3, 9, 64, 65, 200, 400] * 60]
    rows, values = lists(columns)
    a = np.zeros((n, len(columns)))
    for i, c in enumerate(columns):
        a[c, i] = values[i].as_py()
    partial = P._gram_udf(n)
    tracemalloc.start()
    blocks = list(partial(iter([pa.RecordBatch.from_arrays([rows, values], ["rows", "values"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.zeros((n, n))
    for b in blocks:
        start, part = b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_buffer()).reshape(-1, n)
        got[start : start + len(part)] += part
    assert np.abs(got - a @ a.T).max() < 1e-6
    # products with an identity held several times 32,768 rows of n numbers, here 105 MB each
    assert peak < 12 * n * n * 8


class Shared:
    def __init__(self, value):
        self.value = value


def test_sums_of_a_batch_of_long_texts_need_little_more_than_a_piece(monkeypatch):
    table = {"hashes": np.arange(100), "weights": np.ones(100), "starts": np.arange(101), "rows": np.arange(100, dtype=np.int32), "values": np.ones(100, np.float32), "basis": np.eye(100, dtype=np.float32)[:, :4].copy()}
    monkeypatch.setattr(T.F, "arrow_udf", lambda f, kind: f)
    add = T._sum_udf(Shared(table), damped=False, unit=None)
    hashes = pa.array(np.tile(np.arange(1000), 1500).reshape(1500, 1000).tolist(), pa.list_(pa.int64()))
    whole = T.sum_batch(hashes.slice(0, 3), table, False)[:, :-1]
    tracemalloc.start()
    got = add(hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.array(got.to_pylist()[:3]), whole) and len(got) == 1500
    # all of the batch at a time took 37.5 MB
    assert peak < 20e6


def test_only_common_terms_pass_through_the_driver(spark):
    rows = [(i, 1.0 + i % 10, None, None, [float(i), 1.0]) for i in range(100)]
    terms = spark.createDataFrame(rows, "hash long, weight double, rows array<int>, values array<float>, vector array<float>")
    table = T.TermTable(terms, np.zeros((0, 2), np.float32), 100, dense_count=100)
    near, far = table.most_common(1000)
    assert sorted(r.weight for r in near.collect()) == [1.0] * 10 + [2.0] * 10 + [3.0] * 10
    assert far.count() == 70
    asked = spark.createDataFrame([(1, [0, 0, 9, 99, 500]), (2, []), (3, None), (4, [9])], "id int, h array<long>")
    for damped in (True, False):
        one, other = ({r.id: r.out for r in T.with_term_sums(asked, "h", table, "out", damped, limit=limit).collect()} for limit in (1 << 20, 1000))
        assert one.keys() == other.keys() and all(np.allclose(one[i], other[i]) for i in one)


def test_products_of_vectors_in_tables_shuffle_one_row_of_a_term_and_part(spark):
    rng = np.random.default_rng(5)
    a = rng.random((12, 9)) * (rng.random((12, 9)) < 0.5)
    own, v = rng.random(12), rng.random((12, 3))
    rows = [(i % 2, i, float(own[i]), [int(t) for t in np.flatnonzero(a[i])], [float(x) for x in a[i][a[i] > 0]], v[i].tolist()) for i in range(12)]
    docs = spark.createDataFrame(rows, "part long, id long, own double, terms array<long>, weights array<float>, v array<double>")
    sums = E._term_sums_by_part(docs, 3, 2, once=False).collect()
    assert len(sums) == sum((a[p::2] > 0).any(axis=0).sum() for p in (0, 1))
    assert all(np.allclose(r.vector, (a.T @ v)[r.term], atol=1e-5) for r in sums)
    got = {r.id: (r.u, r.v) for r in E._product(docs, 3, 2).collect()}
    expected = own[:, None] * v + a @ (a.T @ v)
    assert all(np.allclose(got[i][1], expected[i], atol=1e-4) and np.allclose(got[i][0], v[i]) for i in range(12))


def test_pieces_grow_with_the_input(spark, tmp_path):
    spark.range(200_000).repartition(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert spread(rows).rdd.getNumPartitions() == 4
    assert spread(rows, 10_000).rdd.getNumPartitions() == 20


def test_cells_of_many_vectors_and_queries_are_found_a_piece_at_a_time():
    rng = np.random.default_rng(3)
    points, centres = rng.normal(size=(4000, 8)), C.fit_centres(rng.normal(size=(4000, 8)), 2000, rounds=1)
    index, counts = C.CellIndex("", centres, np.linspace(0, 1, 2000), ""), rng.integers(0, 3, 2000)
    tracemalloc.start()
    own, probed = C.nearest_centre(points, centres), index.probed(points, counts, 10, 0.01)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = index.ranked(points[:50])
    assert np.array_equal(own[:50], order[:, 0])
    for row, ranks in zip(np.unpackbits(probed[:50], axis=1, count=2000, bitorder="little"), order, strict=True):
        depth = max(index.probes(0.01), int(np.argmax(np.cumsum(counts[ranks]) >= 10)) + 1)
        assert sorted(np.flatnonzero(row)) == sorted(ranks[:depth])
    # all at once the similarities alone took 64 MB for the vectors, and with the ranks 200 MB for the queries
    assert peak < 40 * C.PRODUCT_CELLS and probed.nbytes == 4000 * 250
