"""Constraint checks and cascading deletes over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.operators.joins import lookup_join, settled
from reviewmill.schemas import CASCADES, DOMAINS, FOREIGN_KEYS, MAX_LENGTHS, NOT_NULL, RANGES, UNIQUE_KEYS


def _given(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows; NULLs never collide."""
    counts = df.where(_given(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > 1)


def check_table_unique(name: str, df: DataFrame) -> dict[tuple[str, ...], DataFrame]:
    """Violations of every uniqueness rule of a table."""
    return {keys: check_unique(df, keys) for keys in UNIQUE_KEYS.get(name, [])}


def check_foreign_key(
    child: DataFrame,
    parent: DataFrame,
    child_keys: Sequence[str],
    parent_keys: Sequence[str],
    spread: Sequence[str] = ("id",),
) -> DataFrame:
    """Child rows whose (composite) key has no parent; a NULL in the key is no reference."""
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, child_keys, strict=True)]).distinct()
    return lookup_join(child.where(_given(child_keys)), known, list(child_keys), "left_anti", spread=spread)


def check_table_foreign_keys(name: str, tables: dict[str, DataFrame]) -> dict[tuple[str, ...], DataFrame]:
    """Orphans of a table under each of its foreign keys."""
    return {
        child_keys: check_foreign_key(tables[name], tables[parent], child_keys, parent_keys)
        for child_keys, parent, parent_keys in FOREIGN_KEYS.get(name, [])
    }


def _tagged(keys: Sequence[str], *tags: Column) -> Column:
    """A struct of tags and a complete key as texts; NULL where the key has a NULL."""
    parts = F.array(*[F.col(k).cast("string") for k in keys])
    return F.when(_given(keys), F.struct(*tags, parts.alias("key")))


def unique_sweep(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rule, key, rows``: violations of every uniqueness rule of all ``tables``.

    Each row becomes one tagged key per rule of its table, so that all rules of all tables share
    one aggregate and one exchange. ``rule`` names the columns, ``key`` holds their values as texts.
    A rule with a column that its table does not have is left out.
    """
    found = []
    for name, df in tables.items():
        rules = [keys for keys in UNIQUE_KEYS.get(name, []) if set(keys) <= set(df.columns)]
        tagged = [_tagged(keys, F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("rule")) for keys in rules]
        if tagged:
            found.append(df.select(F.inline(F.array_compact(F.array(*tagged)))))
    if not found:
        return _nothing(tables, "table_name string, rule string, key array<string>, rows long")
    counts = reduce(DataFrame.unionAll, found).groupBy("table_name", "rule", "key").agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > 1)


def foreign_key_sweep(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rule, id, key``: rows of all ``tables`` whose key has no parent, under every rule.

    The distinct keys of all children meet those of all parents in one join; copies collapse
    before the exchange, so a parent with many children is no hot key. Rules whose parent table
    is not given, or whose columns are absent, are left out.
    """
    children, parents = [], {}
    for name, df in tables.items():
        tagged = []
        for keys, parent, parent_keys in FOREIGN_KEYS.get(name, []):
            if parent in tables and set(keys) <= set(df.columns) and set(parent_keys) <= set(tables[parent].columns):
                target = F.lit(f"{parent}({','.join(parent_keys)})").alias("target")
                tagged.append(_tagged(keys, F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("rule"), target))
                parents[parent, parent_keys] = tables[parent].select(F.inline(F.array_compact(F.array(_tagged(parent_keys, target)))))
        if tagged:
            children.append(df.select(F.col("id").cast("string").alias("id"), F.inline(F.array_compact(F.array(*tagged)))))
    if not children:
        return _nothing(tables, "table_name string, rule string, id string, key array<string>")
    rows = reduce(DataFrame.unionAll, children)
    asked = rows.select("target", "key").distinct()
    orphans = asked.join(reduce(DataFrame.unionAll, parents.values()).distinct(), ["target", "key"], "left_anti")
    return lookup_join(rows, orphans, ["target", "key"], "left_semi", spread=["id"]).select("table_name", "rule", "id", "key")


def domain_sweep(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, id, violation`` over all ``tables``; nothing is shuffled."""
    found = [
        check_domain(name, df).select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id"), "violation") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, found) if found else _nothing(tables, "table_name string, id string, violation string")


def _nothing(tables: dict[str, DataFrame], schema: str) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    return spark.createDataFrame([], schema)


def check_domain(name: str, df: DataFrame) -> DataFrame:
    """``id, violation`` for values outside the enums, NULL rules, lengths and ranges."""
    found: list[Column] = []
    for column, allowed in DOMAINS.get(name, {}).items():
        if column in df.columns:
            found.append(F.when(~F.col(column).isin(*allowed), F.lit(f"{column}: not in domain")))
    for column in NOT_NULL.get(name, ()):
        if column in df.columns:
            found.append(F.when(F.col(column).isNull(), F.lit(f"{column}: null")))
    for column, length in MAX_LENGTHS.get(name, {}).items():
        if column in df.columns:
            found.append(F.when(F.length(column) > length, F.lit(f"{column}: longer than {length}")))
    for column, (low, high) in RANGES.get(name, {}).items():
        if column in df.columns:
            found.append(F.when(~F.col(column).between(low, high), F.lit(f"{column}: outside {low}..{high}")))
    if not found:
        return df.where(F.lit(False)).select("id", F.lit("").alias("violation"))
    return df.select("id", F.explode(F.array_compact(F.array(*found))).alias("violation"))


def purge_cascade(tables: dict[str, DataFrame], root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows ``ids`` of ``root`` and all that hangs below them.

    Works down the ownership tree. The ids to remove from a table are written once and serve
    the table and all that hangs below it; a table is not shuffled while they are few.
    """
    order = [root]
    for parent in order:
        order += [child for child, _ in CASCADES.get(parent, []) if child not in order]
    # A child comes after all of its parents that are part of this purge.
    order.sort(key=lambda t: list(FOREIGN_KEYS_ORDER).index(t))
    gone: dict[str, tuple[DataFrame, bool]] = {root: settled(ids.select("id").distinct())}
    left = dict(tables)
    if root in tables:
        known, small = gone[root]
        left[root] = lookup_join(tables[root], known, ["id"], "left_anti", spread=["id"], small=small)
    for name in order:
        if name == root or name not in tables:
            continue
        links = [(p, c) for p, kids in CASCADES.items() for k, c in kids if k == name and p in gone]
        removed = []
        for parent, column in links:
            keys, small = gone[parent][0].select(F.col("id").alias(column)), gone[parent][1]
            if name in CASCADES:
                removed.append(lookup_join(tables[name], keys, [column], "left_semi", spread=["id"], small=small).select("id"))
            left[name] = lookup_join(left[name], keys, [column], "left_anti", spread=["id"], small=small)
        if removed:
            gone[name] = settled(reduce(DataFrame.union, removed).distinct())
    return left


# Parents before children.
FOREIGN_KEYS_ORDER = (
    "organizations", "users", "memberships", "products", "sources", "reviews", "import_jobs",
    "review_sentiments", "review_embeddings",
)
