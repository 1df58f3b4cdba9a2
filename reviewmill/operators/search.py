"""Nearest reviews by cosine similarity: exact, for one query and for many at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.vectors import as_matrix, cosine_to
from reviewmill.operators.joins import settled
from reviewmill.schemas import SEARCH_LIMIT
from reviewmill.session import cut_lineage

QUERIES_PER_PASS = 16_384
PRODUCT_CELLS = 1 << 22
# Similarities closer than this are ties, broken by id.
_DIGITS = 12


def in_scope(
    embeddings: DataFrame, organization_id: object = None, product_id: object = None, model_version: object = None
) -> DataFrame:
    """Rows of one tenant, product and version; filters reach the scan and prune partitions."""
    scope = {"organization_id": organization_id, "product_id": product_id, "model_version": model_version}
    for column, value in scope.items():
        if value is not None:
            embeddings = embeddings.where(F.col(column) == F.lit(value))
    return embeddings


def nearest(embeddings: DataFrame, query: Sequence[float], limit: int = SEARCH_LIMIT) -> DataFrame:
    """``review_id, similarity`` of the ``limit`` nearest vectors, best first.

    Each task keeps its own best rows; only those meet. Vectors are read, never shuffled.
    """
    scored = embeddings.select("review_id", F.round(cosine_to("embedding", query), _DIGITS).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc_nulls_last(), "review_id").limit(limit)


def with_reviews(hits: DataFrame, reviews: DataFrame) -> DataFrame:
    """Hits with the review columns a user sees; hits are broadcast when their files are small."""
    hits, small = settled(hits)
    shown = reviews.select(
        F.col("id").alias("review_id"), "text_redacted", "language", "rating", "occurred_at"
    )
    return shown.join(F.broadcast(hits) if small else hits, "review_id").orderBy(F.col("similarity").desc_nulls_last(), "review_id")


def search_similar(
    embeddings: DataFrame,
    reviews: DataFrame,
    query: Sequence[float],
    limit: int = SEARCH_LIMIT,
    **scope: object,
) -> DataFrame:
    """The nearest reviews within tenant, product and version, with their review rows.

    Every vector belongs to a stored review, so the nearest are found before the join. Should
    one of them have lost its review, only vectors that still have one are searched.
    """
    scoped = in_scope(embeddings, **scope)
    hits, small = settled(nearest(scoped, query, limit))
    ids = reviews.select(F.col("id").alias("review_id"))
    if ids.join(F.broadcast(hits) if small else hits, "review_id", "left_semi").count() < hits.count():
        hits = nearest(scoped.join(ids, "review_id", "left_semi"), query, limit)
    return with_reviews(hits, reviews)


def search_many(
    embeddings: DataFrame,
    queries: DataFrame,
    limit: int = SEARCH_LIMIT,
    queries_per_pass: int = QUERIES_PER_PASS,
    **scope: object,
) -> DataFrame:
    """``query_id, review_id, similarity, rank`` of the nearest vectors of every query.

    Queries (``query_id, embedding``) go out in blocks of bounded size. A task compares its
    vectors with a block as a matrix product and keeps the best ``limit`` per query, so no
    pair is ever a row and each task sends at most ``limit`` rows per query.
    """
    vectors = in_scope(embeddings, **scope).select("review_id", "embedding")
    id_type = vectors.schema["review_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, review_id {id_type}, similarity double"
    found: DataFrame | None = None
    queries = cut_lineage(queries.select("query_id", "embedding"), "queries")
    blocks = max(1, -(-queries.count() // queries_per_pass))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for i in range(blocks):
        rows = queries.where(block == i).toArrow()
        if not rows.num_rows:
            continue
        matrix, _ = as_matrix(rows["embedding"].combine_chunks(), len(rows["embedding"][0]))
        best = vectors.mapInArrow(best_per_query(rows["query_id"].combine_chunks(), unit_rows(matrix), limit), schema)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    ranking = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "review_id")
    return found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= limit)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(lengths > 0, lengths, 1)[:, None]


def best_per_query(query_ids: pa.Array, matrix: np.ndarray, limit: int, probed: np.ndarray | None = None):
    """The best ``limit`` rows of each query (a row of unit length in ``matrix``) among a task's rows.

    With ``probed`` (a row of bits per query, one per cell) a query meets the rows of its cells only, by
    the column ``cell``.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, held, rows = np.full(len(matrix), -np.inf), [], 0

        def kept() -> pa.Table:
            together = pa.concat_tables(held)
            order = pc.sort_indices(together, sort_keys=[("q", "ascending"), ("similarity", "descending"), ("review_id", "ascending")])
            together = together.take(order)
            q = together["q"].to_numpy()
            starts = np.searchsorted(q, q)
            first = np.arange(len(q)) - starts < limit
            together, q = together.filter(pa.array(first)), q[first]
            last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.empty(0, np.int64)
            full = np.bincount(q, minlength=len(matrix))[q[last]] == limit
            floor[q[last[full]]] = together["similarity"].to_numpy()[last[full]]
            return together

        for batch in batches:
            x, given = as_matrix(batch.column("embedding"), matrix.shape[1])
            x = unit_rows(x)
            cell = np.zeros(len(x), np.int64) if probed is None else batch.column("cell").to_numpy()
            for c in np.unique(cell):
                asked = np.arange(len(matrix)) if probed is None else np.flatnonzero(probed[:, c >> 3] >> (c & 7) & 1)
                mine = np.flatnonzero((cell == c) & given)
                step = max(1, PRODUCT_CELLS // max(1, len(mine)))
                for low in range(0, len(asked), step):
                    some = asked[low : low + step]
                    sims = np.round(x[mine] @ matrix[some].T, _DIGITS)
                    edge = floor[some]
                    if len(mine) > limit:
                        edge = np.maximum(edge, np.partition(sims, len(mine) - limit, axis=0)[len(mine) - limit])
                    r, q = np.nonzero(sims >= edge)
                    held.append(pa.table({"q": some[q], "review_id": batch.column("review_id").take(pa.array(mine[r])), "similarity": sims[r, q]}))
                    rows += len(r)
                    if rows > 4 * limit * len(matrix) + (1 << 16):
                        held = [kept()]
                        rows = held[0].num_rows
        if held:
            out = kept()
            for b in pa.table({"query_id": query_ids.take(out["q"].combine_chunks()), "review_id": out["review_id"], "similarity": out["similarity"]}).to_batches():
                yield b

    return best
