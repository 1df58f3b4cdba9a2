"""Jobs that bring reviews up to date with a model version: sentiment and embeddings.

Running a job again finds nothing to do; a new version adds rows and leaves the old ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.ids import uuid7
from reviewmill.operators.analytics import label_counts
from reviewmill.operators.incremental import mark_ready, pending_reviews, upsert_embeddings, upsert_sentiments
from reviewmill.schemas import EMBEDDING_MODEL_NAME, SENTIMENT_MODEL_NAME
from reviewmill.session import cut_lineage

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class SentimentRun:
    scored: DataFrame
    sentiments: DataFrame
    reviews: DataFrame
    counts: DataFrame

    @property
    def analyzed(self) -> int:
        return self.scored.count()


@dataclass
class EmbeddingRun:
    embedded_rows: DataFrame
    embeddings: DataFrame

    @property
    def embedded(self) -> int:
        return self.embedded_rows.count()


def _result_rows(rows: DataFrame, name: str, version: str, created_at: Column, values: list[str]) -> DataFrame:
    """Rows of a versioned result table; ids follow from review and version."""
    identity = uuid7(F.unix_millis(created_at), F.col("id"), F.lit(version))
    return rows.select(
        identity.alias("id"),
        "organization_id",
        "product_id",
        F.col("id").alias("review_id"),
        F.lit(name).alias("model_name"),
        F.lit(version).alias("model_version"),
        *values,
        created_at.alias("created_at"),
    )


def _read_by(scorer: Scorer, reviews: DataFrame) -> DataFrame:
    """Of a scorer that names what it ``reads``, only these columns and what a result keeps."""
    reads = getattr(scorer, "reads", None)
    return reviews if reads is None else reviews.select(*dict.fromkeys(("id", "organization_id", "product_id", *reads)))


def score_reviews(reviews: DataFrame, analyzer: Scorer, version: str, created_at: Column, name: str = SENTIMENT_MODEL_NAME) -> DataFrame:
    """Sentiment rows of all given reviews."""
    return _result_rows(analyzer(_read_by(analyzer, reviews)), name, version, created_at, ["label", "score"])


def embed_reviews(reviews: DataFrame, embedder: Scorer, version: str, created_at: Column, name: str = EMBEDDING_MODEL_NAME) -> DataFrame:
    """Embedding rows of all given reviews."""
    return _result_rows(embedder(_read_by(embedder, reviews)), name, version, created_at, ["embedding"])


def analyze_pending(
    reviews: DataFrame,
    sentiments: DataFrame,
    analyzer: Scorer,
    version: str,
    created_at: Column,
    limit: int | None = None,
    **scope: object,
) -> SentimentRun:
    """Score what has no result for ``version`` yet, merge the results, mark reviews ready."""
    todo = pending_reviews(reviews, sentiments, version, limit=limit, **scope)
    scored = cut_lineage(score_reviews(todo, analyzer, version, created_at), "scored")
    return SentimentRun(
        scored=scored,
        sentiments=upsert_sentiments(sentiments, scored),
        reviews=mark_ready(reviews, scored),
        counts=label_counts(scored),
    )


def embed_pending(
    reviews: DataFrame,
    embeddings: DataFrame,
    embedder: Scorer,
    version: str,
    created_at: Column,
    limit: int | None = None,
    **scope: object,
) -> EmbeddingRun:
    """Embed what has no vector for ``version`` yet and merge the vectors."""
    todo = pending_reviews(reviews, embeddings, version, limit=limit, **scope)
    rows = cut_lineage(embed_reviews(todo, embedder, version, created_at), "embedded")
    return EmbeddingRun(embedded_rows=rows, embeddings=upsert_embeddings(embeddings, rows))
