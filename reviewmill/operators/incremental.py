"""What is still to do for a model version, and merging results keyed (review, version)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.joins import lookup_join, settled

RESULT_KEYS = ("review_id", "model_version")


def pending_reviews(
    reviews: DataFrame,
    results: DataFrame,
    model_version: str,
    organization_id: object | None = None,
    product_id: object | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Reviews without a result row for ``model_version`` in their tenant.

    With ``limit``, the oldest ones in order; without, the whole backlog as one job. Both
    sides have one row per review, so the anti join has no hot key; the version filter is
    applied before it.
    """
    done = results.where(F.col("model_version") == F.lit(model_version))
    todo = reviews
    if organization_id is not None:
        todo = todo.where(F.col("organization_id") == F.lit(organization_id))
        done = done.where(F.col("organization_id") == F.lit(organization_id))
    if product_id is not None:
        todo = todo.where(F.col("product_id") == F.lit(product_id))
    done = done.select("organization_id", F.col("review_id").alias("id"))
    todo = todo.join(done, ["organization_id", "id"], "left_anti")
    return todo if limit is None else todo.orderBy("created_at", "id").limit(limit)


def pending_for_sentiment(
    reviews: DataFrame, sentiments: DataFrame, model_version: str, **scope: object
) -> DataFrame:
    return pending_reviews(reviews, sentiments, model_version, **scope)


def pending_for_embedding(
    reviews: DataFrame, embeddings: DataFrame, model_version: str, **scope: object
) -> DataFrame:
    return pending_reviews(reviews, embeddings, model_version, **scope)


def upsert(
    existing: DataFrame, incoming: DataFrame, update: Sequence[str], keys: Sequence[str] = RESULT_KEYS
) -> DataFrame:
    """``existing`` with ``incoming`` merged in: on a key conflict only the ``update`` columns
    change. Both sides have one row per key.

    The batch is written once; with small files it is broadcast, and the stored table is not
    shuffled; otherwise one full outer join does the work.
    """
    keys, update = list(keys), list(update)
    columns = existing.columns
    incoming, small = settled(incoming)
    if small:
        changes = F.broadcast(incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in update], F.lit(True).alias("_hit")))
        merged = existing.join(changes, keys, "left").select(
            *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in columns]
        )
        met = existing.select(*keys).join(F.broadcast(incoming.select(*keys)), keys, "left_semi")
        return merged.unionByName(incoming.select(*columns).join(met, keys, "left_anti"))
    old = existing.select(*keys, F.struct(*columns).alias("_old"))
    new = incoming.select(*keys, F.struct(*columns).alias("_new"))
    either = old.join(new, keys, "full_outer")
    return either.select(
        *[
            F.when(F.col("_new").isNotNull() & (F.lit(c in update) | F.col("_old").isNull()), F.col(f"_new.{c}"))
            .otherwise(F.col(f"_old.{c}"))
            .alias(c)
            for c in columns
        ]
    )


def upsert_sentiments(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new score replaces label and score; id, model name, product and created_at stay."""
    return upsert(existing, incoming, ("label", "score"))


def upsert_embeddings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ("embedding",))


def mark_ready(reviews: DataFrame, scored: DataFrame) -> DataFrame:
    """Reviews with status ``ready`` where ``scored`` (organization_id, review_id) names them."""
    ids = scored.select("organization_id", F.col("review_id").alias("id")).distinct().withColumn("_scored", F.lit(True))
    joined = lookup_join(reviews, ids, ["organization_id", "id"], "left", spread=["id"])
    status = F.when(F.col("_scored"), F.lit("ready")).otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*reviews.columns)
