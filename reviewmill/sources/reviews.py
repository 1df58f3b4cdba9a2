"""Readers for raw review files: CSV, JSON Lines and JSON arrays.

Every reader yields one row per record of every file, good or bad::

    path, row_number, parse_error, and per field a struct(kind, value)

where ``kind`` is how the value was written (``absent`` when it was not). A record that
cannot be parsed has ``parse_error`` set and all fields absent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions.jsontext import cell, explain_json, parse_strict
from reviewmill.functions.text import SPACE
from reviewmill.sources.numbering import file_columns, with_row_numbers

FIELDS = ("text", "occurred_at", "external_id", "rating", "language", "attributes")

# Messages for records that are no objects.
NOT_AN_ARRAY = "json payload must be an array of review objects"
NOT_AN_OBJECT = "value: Input should be a valid dictionary or instance of RawReviewRow"

_ABSENT = "absent"
Paths = str | Sequence[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _no_cell() -> Column:
    return F.struct(F.lit(_ABSENT).alias("kind"), F.lit(None).cast("string").alias("value"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


_CSV = {"multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files grouped by their first record, which may span lines. A record of more than the one
    cell of the schema is kept whole, as it was written."""
    records = (
        spark.read.options(**_CSV, header="false", columnPruning="false", columnNameOfCorruptRecord="_record")
        .schema("c0 string, _record string")
        .csv(paths)
        .select(F.coalesce("_record", "c0", F.lit("")).alias("header"), *file_columns())
    )
    first = records.groupBy("path").agg(F.min_by("header", F.struct("_block", "_seq")).alias("header"))
    grouped: dict[str, list[str]] = defaultdict(list)
    for row in first.toLocalIterator():
        grouped[row.header.removeprefix("\ufeff")].append(row.path)
    return grouped


def read_csv(spark: SparkSession, paths: Paths) -> DataFrame:
    """Header CSV. The header is record 1; blank lines are not counted; a quoted field may
    span lines. Cells missing from a short record are NULL, cells beyond the header are
    dropped, empty cells are empty strings.

    Files are read together with the files that share their header.
    """
    parts = [_read_csv_group(spark, files) for files in _headers(spark, _paths(paths)).values()]
    if not parts:
        empty = spark.createDataFrame([], "path string, row_number long, parse_error string")
        return empty.select("*", *[_no_cell().alias(f) for f in FIELDS])
    return reduce(DataFrame.unionByName, parts)


def _read_csv_group(spark: SparkSession, files: list[str]) -> DataFrame:
    header = spark.read.options(**_CSV, header="false").csv(files[0]).first()
    names = [cell or "" for cell in header]
    names[0] = names[0].removeprefix("\ufeff")
    # Names come from the raw first record and positions go into the schema, so odd or repeated
    # header cells do no harm; the last of several equal headers wins, as it does when a record
    # is read into a dictionary.
    schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", _record string"
    raw = (
        spark.read.options(**_CSV, header="true")
        .option("columnNameOfCorruptRecord", "_record")
        .option("columnPruning", "false")
        .schema(schema)
        .csv(files)
        .select("*", *file_columns())
    )
    numbered = with_row_numbers(raw, first=2)
    # Only a record with another number of cells than the header is kept whole in _record;
    # its cells are counted outside of quoted parts (a doubled quote is two parts that touch).
    bare = F.regexp_replace("_record", r'"[^"]*+"', "")
    cells = F.when(F.col("_record").isNull(), F.lit(len(names))).otherwise(
        F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    )
    position = {name: i for i, name in enumerate(names)}

    def field(name: str) -> Column:
        if name not in position:
            return _no_cell()
        present = F.lit(position[name]) < cells
        return F.struct(
            F.when(present, "string").otherwise("null").alias("kind"),
            F.when(present, F.coalesce(F.col(f"c{position[name]}"), F.lit(""))).alias("value"),
        )

    return numbered.select(
        "path", "row_number", F.lit(None).cast("string").alias("parse_error"),
        *[field(name).alias(name) for name in FIELDS],
    )


def _object_fields(df: DataFrame, is_object: Column) -> DataFrame:
    """Cells of the variant column ``_v``; records that are no objects get an error."""
    good = F.col("parse_error").isNull() & is_object
    return df.select(
        "path",
        "row_number",
        F.coalesce("parse_error", F.when(~is_object, F.lit(NOT_AN_OBJECT))).alias("parse_error"),
        *[F.when(good, cell(F.col("_v"), name)).otherwise(_no_cell()).alias(name) for name in FIELDS],
    )


def read_jsonl(spark: SparkSession, paths: Paths) -> DataFrame:
    """One JSON object per line. Blank lines are skipped but counted."""
    lines = spark.read.text(_paths(paths)).select("value", *file_columns())
    numbered = with_row_numbers(lines, first=1).withColumn("_line", _strip(F.col("value")))
    records = numbered.where(F.col("_line") != "").drop("value")
    parsed = parse_strict(records, "_line", "_v").withColumn(
        "parse_error", F.concat(F.lit("invalid json: "), F.col("_v_message"))
    )
    return _object_fields(parsed, F.col("_line").startswith("{"))


def read_json_array(spark: SparkSession, paths: Paths) -> DataFrame:
    """One JSON array per file, numbered from 1. A file that is malformed or holds something
    else yields a single error row with number 1.

    An array file is a single JSON value, so it is read whole by one task; large imports
    should come as JSON Lines.
    """
    files = spark.read.option("wholetext", "true").text(_paths(paths)).select(
        F.col("_metadata.file_path").alias("path"), _strip(F.col("value")).alias("_text")
    )
    enclosed = F.concat(F.lit('{"items":'), F.col("_text"), F.lit("}"))
    parsed = files.withColumn("_items", F.from_json(enclosed, "items array<variant>")["items"])
    parsed = parsed.withColumn("_problem", explain_json(F.when(F.col("_items").isNull(), F.col("_text"))))
    parsed = parsed.withColumn(
        "_items", F.coalesce("_items", F.from_json(F.col("_problem.canonical"), "array<variant>"))
    ).withColumn(
        "_file_error",
        F.when(
            F.col("_items").isNull(),
            F.coalesce(F.concat(F.lit("invalid json: "), F.col("_problem.message")), F.lit(NOT_AN_ARRAY)),
        ),
    )
    bad = parsed.where(F.col("_file_error").isNotNull()).select(
        "path", F.lit(1).cast("long").alias("row_number"), F.col("_file_error").alias("parse_error"),
        *[_no_cell().alias(name) for name in FIELDS],
    )
    items = (
        parsed.where(F.col("_file_error").isNull())
        .select("path", F.posexplode("_items").alias("_pos", "_v"))
        .withColumn("row_number", F.col("_pos").cast("long") + 1)
        .withColumn("parse_error", F.lit(None).cast("string"))
    )
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    return _object_fields(items, is_object).unionByName(bad)


READERS: dict[str, Callable[[SparkSession, Paths], DataFrame]] = {
    "csv": read_csv,
    "json": read_json_array,
    "jsonl": read_jsonl,
}


def read_reviews(spark: SparkSession, paths: Paths, source_format: str) -> DataFrame:
    """Raw rows of review files in one of the import formats."""
    if source_format not in READERS:
        raise ValueError(f"unknown import format {source_format!r}")
    return READERS[source_format](spark, paths)


def files_not_utf8(spark: SparkSession, paths: Paths) -> DataFrame:
    """Files holding bytes that are not UTF-8; such a file fails as a whole."""
    lines = spark.read.text(_paths(paths)).select("value", F.col("_metadata.file_path").alias("path"))
    return lines.where(~F.is_valid_utf8("value")).select("path").distinct()
