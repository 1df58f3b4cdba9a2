"""Strict JSON parsing into variants, with the parser's own words for what is wrong."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explain_json(c: Column) -> Column:
    """``struct(message, detail, canonical)`` per non-NULL text, in Arrow batches: why the
    text is not JSON, or the same value rewritten if it is after all."""

    def explain(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            message = detail = canonical = None
            if text is not None:
                try:
                    canonical = json.dumps(json.loads(text), ensure_ascii=False)
                except json.JSONDecodeError as exc:
                    message, detail = exc.msg, str(exc)
                except RecursionError:
                    message = detail = "nesting too deep"
            out.append((message, detail, canonical))
        return pd.DataFrame(out, columns=["message", "detail", "canonical"])

    return F.pandas_udf(explain, "message string, detail string, canonical string")(c)


def parse_strict(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``{out}`` (variant), ``{out}_message`` and ``{out}_detail`` for a JSON text column.

    Well-formed text never leaves the JVM. The variant parser ignores what follows the first
    value, so the text is parsed inside brackets, where trailing text is an error. Only the
    rest is handed to Python: it gets an error message, or (repeated keys, which the variant
    parser refuses) a rewritten text.
    """
    source = F.col(text)
    elements = F.from_json(F.concat(F.lit("["), source, F.lit("]")), "array<variant>")
    closed = ~F.contains(source, F.lit("]")) | F.json_object_keys(
        F.concat(F.lit('{"v":'), source, F.lit("}"))
    ).isNotNull()
    step = df.withColumn("_elements", elements)
    good = source.isNotNull() & (F.size("_elements") == 1) & closed
    step = step.withColumn("_value", F.when(good, F.col("_elements")[0])).drop("_elements")
    step = step.withColumn(
        "_problem", explain_json(F.when(F.col("_value").isNull() & source.isNotNull(), source))
    )
    return (
        step.withColumn(out, F.coalesce("_value", F.try_parse_json("_problem.canonical")))
        .withColumn(
            f"{out}_message",
            F.when(
                source.isNotNull() & F.col(out).isNull(),
                F.coalesce("_problem.message", F.lit("number out of range")),
            ),
        )
        .withColumn(
            f"{out}_detail",
            F.when(
                source.isNotNull() & F.col(out).isNull(),
                F.coalesce("_problem.detail", F.lit("number out of range")),
            ),
        )
        .drop("_value", "_problem")
    )


def cell(value: Column, field: str) -> Column:
    """``struct(kind, value)`` of one field of a JSON object held as a variant."""
    part = F.try_variant_get(value, f"$.{field}", "variant")
    type_name = F.schema_of_variant(part)
    kind = (
        F.when(part.isNull(), "absent")
        .when(type_name == "VOID", "null")
        .when(type_name == "STRING", "string")
        .when(type_name == "BOOLEAN", "boolean")
        .when(type_name.startswith("OBJECT"), "object")
        .when(type_name.startswith("ARRAY"), "array")
        .otherwise("number")
    )
    text = F.when(type_name.rlike("^(OBJECT|ARRAY)"), F.to_json(part)).otherwise(
        F.try_variant_get(part, "$", "string")
    )
    return F.struct(kind.alias("kind"), text.alias("value"))
