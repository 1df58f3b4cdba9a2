"""Text search: the query text becomes a vector, the nearest reviews come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from reviewmill.operators.search import search_similar
from reviewmill.schemas import SEARCH_LIMIT


def semantic_search(
    embeddings: DataFrame,
    reviews: DataFrame,
    embedder: Callable[[DataFrame], DataFrame],
    query: str,
    model_version: str,
    organization_id: object,
    product_id: object,
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """``review_id, text_redacted, language, rating, occurred_at, similarity``, best first.

    The query is embedded as it is, without the cleaning that reviews get.
    """
    asked = embeddings.sparkSession.createDataFrame([(query,)], "text_normalized string")
    vector = embedder(asked).first().embedding
    return search_similar(
        embeddings,
        reviews,
        vector,
        limit,
        organization_id=organization_id,
        product_id=product_id,
        model_version=model_version,
    )
