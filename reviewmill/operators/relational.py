"""Tenant-scoped reads: point lookups, ordered pages, and the source ownership check.

Filters on ``organization_id`` and ``product_id`` prune partitions of tables written by
``sources.tables``; ordered pages become a per-task top-k, never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.joins import lookup_join
from reviewmill.schemas import LIST_LIMIT

# What an import request is told when its target does not exist.
NO_ORGANIZATION = "organization not found"
NO_PRODUCT = "product not found"
NO_SOURCE = "source not found for product"


class TenantViolation(ValueError):
    """Rows of another tenant in a write."""


def tenant_scope(df: DataFrame, organization_id: object | None) -> DataFrame:
    """Only this tenant's rows; without a tenant, no rows."""
    if organization_id is None:
        return df.where(F.lit(False))
    return df.where(F.col("organization_id") == F.lit(organization_id))


def check_tenant_writes(df: DataFrame, organization_id: object) -> DataFrame:
    """Rows that may not be written under this tenant."""
    return df.where(~F.col("organization_id").eqNullSafe(F.lit(organization_id)))


def require_tenant(df: DataFrame, organization_id: object) -> DataFrame:
    """``df`` itself, or an error when it carries rows of another tenant."""
    if not check_tenant_writes(df, organization_id).isEmpty():
        raise TenantViolation(f"rows outside of organization {organization_id!r}")
    return df


def get_by_id(df: DataFrame, row_id: object, organization_id: object | None = None) -> DataFrame:
    """The row with this id; all tables but organizations are also scoped by tenant."""
    found = df.where(F.col("id") == F.lit(row_id))
    return found if organization_id is None else tenant_scope(found, organization_id)


def _page(df: DataFrame, newest_by: str, limit: int | None, offset: int) -> DataFrame:
    ordered = df.orderBy(F.col(newest_by).desc(), F.col("id"))
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def list_organizations(organizations: DataFrame, limit: int = LIST_LIMIT, offset: int = 0) -> DataFrame:
    return _page(organizations, "created_at", limit, offset)


def list_products(
    products: DataFrame, organization_id: object, limit: int = LIST_LIMIT, offset: int = 0
) -> DataFrame:
    return _page(tenant_scope(products, organization_id), "created_at", limit, offset)


def list_sources_for_product(sources: DataFrame, organization_id: object, product_id: object) -> DataFrame:
    owned = tenant_scope(sources, organization_id).where(F.col("product_id") == F.lit(product_id))
    return _page(owned, "created_at", None, 0)


def list_reviews_for_product(
    reviews: DataFrame, organization_id: object, product_id: object, limit: int | None = LIST_LIMIT, offset: int = 0
) -> DataFrame:
    owned = tenant_scope(reviews, organization_id).where(F.col("product_id") == F.lit(product_id))
    return _page(owned, "occurred_at", limit, offset)


def valid_source_chain(
    requests: DataFrame,
    organizations: DataFrame,
    products: DataFrame,
    sources: DataFrame,
    request_key: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Add ``problem`` to requests (organization_id, product_id, source_id): the first link
    that does not exist, or NULL."""

    def link(df: DataFrame, parents: DataFrame, columns: dict[str, Column], flag: str) -> DataFrame:
        known = parents.select(*[c.alias(name) for name, c in columns.items()]).distinct()
        return lookup_join(df, known.withColumn(flag, F.lit(True)), list(columns), "left", spread=request_key)

    org, product = F.col("organization_id"), F.col("product_id")
    step = link(requests, organizations, {"organization_id": F.col("id")}, "_organization")
    step = link(step, products, {"organization_id": org, "product_id": F.col("id")}, "_product")
    step = link(
        step, sources, {"organization_id": org, "product_id": product, "source_id": F.col("id")}, "_source"
    )
    return step.withColumn(
        "problem",
        F.when(F.col("_organization").isNull(), NO_ORGANIZATION)
        .when(F.col("_product").isNull(), NO_PRODUCT)
        .when(F.col("_source").isNull(), NO_SOURCE),
    ).drop("_organization", "_product", "_source")
