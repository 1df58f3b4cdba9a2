"""Row validation as projections with an error channel: no row ever stops a job.

Input rows carry a ``struct(kind, value)`` per field (see ``sources.reviews``). Output rows
carry typed fields and ``error``: NULL, or the first failing field in declared order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.jsontext import parse_strict
from reviewmill.functions.text import SPACE

# Validation messages.
FIELD_REQUIRED = "Field required"
NOT_A_STRING = "Input should be a valid string"
NOT_A_DATETIME = "Input should be a valid datetime"
NOT_A_DATE = "Input should be a valid datetime or date, "
NOT_AN_INTEGER = "Input should be a valid integer"
NOT_AN_INTEGER_TEXT = "Input should be a valid integer, unable to parse string as an integer"
NOT_A_WHOLE_NUMBER = "Input should be a valid integer, got a number with a fractional part"
NOT_A_DICTIONARY = "Input should be a valid dictionary"
BLANK_TEXT = "Value error, text must not be blank"
RATING_BOUNDS = "Value error, rating must be between 1 and 5"
TOO_LATE = "dates after 9999 are not supported as unix timestamps"
YEAR_ZERO = "Input should be a valid datetime, year 0 is out of range"
TOO_EARLY = "dates before 0000 are not supported as unix timestamps"

# Numbers beyond this are milliseconds; first and last accepted epoch second.
MILLIS_THRESHOLD = 2e10
FIRST_EPOCH_SECOND = -62167219200
LAST_EPOCH_SECOND = 253402300799

_NUMBER = r"^[+\-−]?(?:\d+\.?\d*|\.\d+)$"
_INTEGER = r"^[+-]?\d+(?:_\d+)*(?:\.0+)?$"
_DATETIME = (
    r"^(\d{4}-\d{2}-\d{2})(?:[Tt _]((?:[01]\d|2[0-3]):[0-5]\d)(:[0-5]\d(?:[.,]\d+)?)?"
    r"([Zz]|[+\-−](?:[01]\d|2[0-3]):?[0-5]\d)?)?$"
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Nothing but white space, the separators U+001C to U+001F among it."""
    return ~c.rlike(f"(?U)[^{SPACE}]")


def blank_to_null(c: Column) -> Column:
    """Whitespace-only text counts as not given."""
    return F.when(~is_blank(c), strip(c))


def validate_text(c: Column) -> tuple[Column, Column]:
    """(value, problem): required, a string, stripped, not blank."""
    text = strip(c["value"])
    problem = (
        F.when(c["kind"] == "absent", FIELD_REQUIRED)
        .when(c["kind"] != "string", NOT_A_STRING)
        .when(is_blank(c["value"]), BLANK_TEXT)
    )
    return F.when(problem.isNull(), text), problem


def _epoch_problem(number: Column) -> Column:
    seconds = F.when(F.abs(number) > MILLIS_THRESHOLD, number / 1000).otherwise(number)
    return F.when(seconds > LAST_EPOCH_SECOND, TOO_LATE).when(seconds < FIRST_EPOCH_SECOND, TOO_EARLY)


def _epoch_timestamp(number: Column) -> Column:
    micros = F.when(F.abs(number) > MILLIS_THRESHOLD, number * 1000).otherwise(number * 1000000)
    return F.when(_epoch_problem(number).isNull(), F.timestamp_micros(F.round(micros).cast("long")))


def _date_problem(c: Column) -> Column:
    """The first thing wrong with a text that is no date and time."""
    month = F.substring(c, 6, 2)
    return F.concat(
        F.lit(NOT_A_DATE),
        F.when(F.length(c) < 10, "input is too short")
        .when(~c.rlike(r"^\d{4}"), "invalid character in year")
        .when(~c.rlike(r"^.{4}-"), "invalid date separator, expected `-`")
        .when(~c.rlike(r"^.{5}\d\d"), "invalid character in month")
        .when(~month.rlike(r"^(0[1-9]|1[0-2])$"), "month value is outside expected range of 1-12")
        .when(~c.rlike(r"^.{7}-"), "invalid date separator, expected `-`")
        .when(~c.rlike(r"^.{8}\d\d"), "invalid character in day")
        .when(F.substring(c, 1, 10).try_cast("date").isNull(), "day value is outside expected range")
        .otherwise("unexpected extra characters at the end of the input"),
    )


def _datetime_timestamp(c: Column) -> Column:
    """ISO text to an instant; text without a zone is UTC whatever the session zone is."""
    seconds = F.regexp_extract(c, _DATETIME, 3)
    zone = F.replace(F.regexp_extract(c, _DATETIME, 4), F.lit("−"), F.lit("-"))
    clock = F.concat(
        F.regexp_extract(c, _DATETIME, 1),
        F.lit(" "),
        F.coalesce(F.nullif(F.regexp_extract(c, _DATETIME, 2), F.lit("")), F.lit("00:00")),
        F.when(seconds == "", ":00").otherwise(F.substring(seconds, 1, 3)),
        F.when(F.length(seconds) > 3, F.concat(F.lit("."), F.substring(seconds, 5, 6))).otherwise(""),
        F.lit("Z"),
    )
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int")
    offset = F.when(F.length(zone) < 2, F.lit(0)).otherwise(
        F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    )
    instant = F.unix_micros(clock.try_cast("timestamp")) - offset.cast("long") * 60000000
    return F.when(c.rlike(_DATETIME), F.timestamp_micros(instant))


def iso_timestamp(c: Column) -> Column:
    """The instant of a text that is an ISO date or date-time and not a plain number."""
    text = c["value"]
    return F.when((c["kind"] == "string") & ~text.rlike(_NUMBER), _datetime_timestamp(text))


def parse_occurred_at(c: Column, iso: Column | None = None) -> tuple[Column, Column]:
    """(value, problem): epoch numbers (seconds, or milliseconds when large), as numbers or
    text, before ISO dates and date-times. Pass ``iso`` when ``iso_timestamp`` of the cell is
    already a column, so that it is worked out once."""
    iso = iso_timestamp(c) if iso is None else iso
    kind, text = c["kind"], c["value"]
    is_number = (kind == "number") | ((kind == "string") & text.rlike(_NUMBER))
    number = F.replace(text, F.lit("−"), F.lit("-")).try_cast("double")
    value = F.when(is_number, _epoch_timestamp(number)).otherwise(iso)
    epoch_problem = F.when(is_number, F.concat(F.lit(NOT_A_DATE), _epoch_problem(number)))
    problem = (
        F.when(kind == "absent", FIELD_REQUIRED)
        .when(~kind.isin("string", "number"), NOT_A_DATETIME)
        .when(is_number, epoch_problem)
        .when(text.startswith("0000-") & iso.isNotNull(), YEAR_ZERO)
        .when(iso.isNull(), _date_problem(text))
    )
    return F.when(problem.isNull(), value), problem


def parse_rating(c: Column) -> tuple[Column, Column]:
    """(value, problem): whole numbers 1..5 written as number, text or boolean; blank is NULL."""
    kind = c["kind"]
    text = blank_to_null(c["value"])
    given = ~kind.isin("absent", "null") & ~((kind == "string") & text.isNull())
    number = (
        F.when(kind == "boolean", F.when(c["value"] == "true", 1.0).otherwise(0.0))
        .when(kind == "number", c["value"].try_cast("double"))
        .when(text.rlike(_INTEGER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    )
    problem = F.when(
        given,
        F.when(kind.isin("object", "array"), NOT_AN_INTEGER)
        .when((kind == "string") & number.isNull(), NOT_AN_INTEGER_TEXT)
        .when(number != F.floor(number), NOT_A_WHOLE_NUMBER)
        .when(~number.between(1, 5), RATING_BOUNDS),
    )
    return F.when(given & problem.isNull(), number.try_cast("smallint")), problem


def optional_text(c: Column) -> tuple[Column, Column]:
    """(value, problem): a string, or not given when absent, NULL or blank."""
    problem = F.when(~c["kind"].isin("absent", "null", "string"), NOT_A_STRING)
    return F.when(problem.isNull(), blank_to_null(c["value"])), problem


def parse_attributes(df: DataFrame, field: str = "attributes") -> DataFrame:
    """Add ``_attributes`` (JSON object text) and ``_attributes_problem``.

    Objects are kept; text is parsed as JSON and must hold an object; blank or absent is an
    empty object.
    """
    c = F.col(field)
    kind, text = c["kind"], strip(c["value"])
    step = df.withColumn("_json", F.when((kind == "string") & (text != ""), text))
    step = parse_strict(step, "_json", "_parsed")
    is_object = F.schema_of_variant("_parsed").startswith("OBJECT")
    problem = F.when(
        F.col("_json").isNotNull(),
        F.when(F.col("_parsed").isNull(), F.concat(F.lit("Value error, "), F.col("_parsed_detail"))).when(
            ~is_object, NOT_A_DICTIONARY
        ),
    ).when(~kind.isin("absent", "object", "string"), NOT_A_DICTIONARY)
    value = F.when(kind == "object", c["value"]).otherwise(F.coalesce(F.to_json("_parsed"), F.lit("{}")))
    return (
        step.withColumn("_attributes_problem", problem)
        .withColumn("_attributes", F.when(F.col("_attributes_problem").isNull(), value))
        .drop("_json", "_parsed", "_parsed_message", "_parsed_detail")
    )


def first_error(problems: dict[str, Column]) -> Column:
    """``field: message`` of the first field with a problem, in the given order."""
    return F.coalesce(*[F.concat(F.lit(f"{name}: "), problem) for name, problem in problems.items()])


def validate_rows(raw: DataFrame) -> DataFrame:
    """Typed fields plus ``error``; every other column of ``raw`` is kept."""
    fields = ("text", "occurred_at", "external_id", "rating", "language", "attributes")
    kept = [name for name in raw.columns if name not in (*fields, "parse_error")]
    df = parse_attributes(raw).withColumn("_iso", iso_timestamp(F.col("occurred_at")))
    text, text_problem = validate_text(F.col("text"))
    occurred, occurred_problem = parse_occurred_at(F.col("occurred_at"), F.col("_iso"))
    external, external_problem = optional_text(F.col("external_id"))
    rating, rating_problem = parse_rating(F.col("rating"))
    language, language_problem = optional_text(F.col("language"))
    error = F.coalesce(
        F.col("parse_error"),
        first_error(
            {
                "text": text_problem,
                "occurred_at": occurred_problem,
                "external_id": external_problem,
                "rating": rating_problem,
                "language": language_problem,
                "attributes": F.col("_attributes_problem"),
            }
        ),
    )
    return df.select(
        *kept,
        error.alias("error"),
        text.alias("text"),
        occurred.alias("occurred_at"),
        external.alias("external_id"),
        rating.alias("rating"),
        language.alias("language"),
        F.col("_attributes").alias("attributes"),
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, error rows with ``row_number`` and ``reason``)."""
    valid = validated.where(F.col("error").isNull()).drop("error")
    kept = [c for c in ("path", "row_number") if c in validated.columns]
    errors = validated.where(F.col("error").isNotNull()).select(*kept, F.col("error").alias("reason"))
    return valid, errors
