"""Time-ordered identifiers (RFC 9562 version 7) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7(millis: Column, *seed: Column) -> Column:
    """A version-7 UUID from a 48-bit millisecond column.

    With ``seed`` columns the random bits are a digest of them, so a retried task or a
    replayed batch writes the same id again; without, they come from ``uuid()``.
    """
    bits = (
        F.sha2(F.concat_ws("\x1f", *[s.cast("string") for s in seed]), 256)
        if seed
        else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    )
    time_hex = F.lpad(F.lower(F.hex(millis.cast("long"))), 12, "0")
    variant = F.substring(
        F.lit("89ab"),
        (F.conv(F.substring(bits, 4, 1), 16, 10).cast("int") % 4) + 1,
        F.lit(1),
    )
    return F.concat(
        F.substring(time_hex, 1, 8), F.lit("-"), F.substring(time_hex, 9, 4), F.lit("-7"),
        F.substring(bits, 1, 3), F.lit("-"), variant, F.substring(bits, 5, 3), F.lit("-"),
        F.substring(bits, 9, 12),
    )


def uuid7_millis(c: Column | str) -> Column:
    """Milliseconds since the epoch held in a version-7 UUID; other versions are an error."""
    col = F.col(c) if isinstance(c, str) else c
    plain = F.replace(col, F.lit("-"), F.lit(""))
    return F.when(col.isNull(), F.lit(None).cast("long")).when(
        F.substring(plain, 13, 1) == "7", F.conv(F.substring(plain, 1, 12), 16, 10).cast("long")
    ).otherwise(F.raise_error(F.concat(F.lit("not a version 7 UUID: "), col)).cast("long"))
