"""Published models: one directory per version under ``models/sentiment`` and
``models/embeddings``, with the terms as Parquet and the description as JSON."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from reviewmill.operators.embedding import EmbeddingModel
from reviewmill.operators.sentiment import Evaluation, SentimentModel
from reviewmill.schemas import SENTIMENT_LABELS

# Where models live.
SENTIMENT_PREFIX = "models/sentiment"
EMBEDDING_PREFIX = "models/embeddings"


def _write_json(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    line = json.dumps(value)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first().value)


def _number_rows(df: DataFrame) -> list[dict[str, Any]]:
    return [row.asDict() for row in df.limit(len(SENTIMENT_LABELS)).collect()]


def report_of(evaluation: Evaluation) -> dict[str, Any]:
    """The evaluation as one JSON value; it has one row per label, whatever was scored."""
    summary = evaluation.summary.first().asDict()
    matrix = {row["truth"]: [row[name] for name in SENTIMENT_LABELS] for row in _number_rows(evaluation.matrix)}
    metrics = {row["label"]: row for row in _number_rows(evaluation.per_label)}
    return {
        **summary,
        "labels": list(SENTIMENT_LABELS),
        "per_label": {
            name: {key: metrics[name][key] for key in ("precision", "recall", "f1", "support")}
            for name in SENTIMENT_LABELS
        },
        "confusion_matrix": [matrix[name] for name in SENTIMENT_LABELS],
    }


def save_sentiment_model(
    spark: SparkSession, root: str, version: str, model: SentimentModel, evaluation: Evaluation
) -> None:
    base = f"{root.rstrip('/')}/{SENTIMENT_PREFIX}/{version}"
    model.terms.write.mode("overwrite").parquet(f"{base}/terms")
    _write_json(spark, f"{base}/evaluation.json", report_of(evaluation))
    description = {"labels": model.labels, "intercepts": model.intercepts, "term_count": model.term_count}
    _write_json(spark, f"{base}/model.json", description)


def load_sentiment_model(spark: SparkSession, root: str, version: str) -> SentimentModel:
    base = f"{root.rstrip('/')}/{SENTIMENT_PREFIX}/{version}"
    return SentimentModel(terms=spark.read.parquet(f"{base}/terms"), **_read_json(spark, f"{base}/model.json"))


def load_report(spark: SparkSession, root: str, version: str) -> dict[str, Any]:
    return _read_json(spark, f"{root.rstrip('/')}/{SENTIMENT_PREFIX}/{version}/evaluation.json")


def save_embedding_model(spark: SparkSession, root: str, version: str, model: EmbeddingModel) -> None:
    base = f"{root.rstrip('/')}/{EMBEDDING_PREFIX}/{version}"
    model.terms.write.mode("overwrite").parquet(f"{base}/terms")
    rows = [(i, row) for i, row in enumerate(model.basis.tolist())]
    spark.createDataFrame(rows, "place int, vector array<float>").write.mode("overwrite").parquet(f"{base}/basis")
    _write_json(spark, f"{base}/metadata.json", model.metadata())
    sizes = {"term_count": model.term_count, "entries": model.entries, "dense_count": model.dense_count}
    _write_json(spark, f"{base}/model.json", sizes)


def load_embedding_model(spark: SparkSession, root: str, version: str) -> EmbeddingModel:
    base = f"{root.rstrip('/')}/{EMBEDDING_PREFIX}/{version}"
    known = load_metadata(spark, root, version)
    width = known["effective_dimensions"]
    # The basis was bounded by the broadcast limit when the model was fitted.
    rows = spark.read.schema("place int, vector array<float>").parquet(f"{base}/basis").orderBy("place").select("vector").toArrow()
    flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return EmbeddingModel(
        terms=spark.read.parquet(f"{base}/terms"),
        basis=flat.astype(np.float32).reshape(-1, width),
        dimensions=known["requested_dimensions"],
        effective_dimensions=width,
        corpus_size=known["corpus_size"],
        **_read_json(spark, f"{base}/model.json"),
    )


def load_metadata(spark: SparkSession, root: str, version: str) -> dict[str, Any]:
    return _read_json(spark, f"{root.rstrip('/')}/{EMBEDDING_PREFIX}/{version}/metadata.json")
