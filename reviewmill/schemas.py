"""Table schemas (as DDL), domains and constraints of the review model."""

from __future__ import annotations

# The domains of the checked string columns.
ORGANIZATION_STATUSES = ("active", "suspended")
MEMBERSHIP_ROLES = ("admin", "analyst", "viewer")
PRODUCT_STATUSES = ("active", "archived")
SOURCE_TYPES = ("csv", "json", "api", "google_play", "app_store", "support", "survey", "other")
REVIEW_STATUSES = ("pending", "ready", "rejected")
IMPORT_FORMATS = ("csv", "json", "jsonl")
IMPORT_JOB_STATUSES = ("pending", "processing", "succeeded", "failed")
SENTIMENT_LABELS = ("negative", "neutral", "positive")

# Limits and widths.
MIN_MEANINGFUL_LENGTH = 3
EMBEDDING_DIMENSIONS = 256
PENDING_LIMIT = 500
SEARCH_LIMIT = 10
LIST_LIMIT = 100
STALE_JOB_LIMIT = 50
STALE_AFTER_MINUTES = 15
MAX_ATTEMPTS = 5
SENTIMENT_MODEL_NAME = "tfidf-logreg"
EMBEDDING_MODEL_NAME = "tfidf-svd"
UNKNOWN_LANGUAGE = "und"


ORGANIZATIONS = (
    "id string, name string, slug string, status string, created_at timestamp, updated_at timestamp"
)
USERS = (
    "id string, auth_subject string, email string, display_name string, is_active boolean, "
    "created_at timestamp, updated_at timestamp"
)
MEMBERSHIPS = (
    "id string, organization_id string, user_id string, role string, created_at timestamp, updated_at timestamp"
)
PRODUCTS = (
    "id string, organization_id string, name string, key string, description string, "
    "default_language string, timezone string, status string, metadata string, "
    "created_at timestamp, updated_at timestamp"
)
SOURCES = (
    "id string, organization_id string, product_id string, name string, source_type string, "
    "external_reference string, configuration_ref string, metadata string, "
    "created_at timestamp, updated_at timestamp"
)
REVIEWS = (
    "id string, organization_id string, product_id string, source_id string, external_id string, "
    "rating smallint, language string, text_redacted string, text_normalized string, "
    "content_hash string, occurred_at timestamp, ingested_at timestamp, status string, "
    "metadata string, created_at timestamp"
)
IMPORT_JOBS = (
    "id string, organization_id string, product_id string, source_id string, object_key string, "
    "source_format string, status string, attempts smallint, dispatched_at timestamp, "
    "started_at timestamp, completed_at timestamp, total_rows int, imported_count int, "
    "duplicate_count int, rejected_count int, error string, created_at timestamp"
)
REVIEW_SENTIMENTS = (
    "id string, organization_id string, product_id string, review_id string, model_name string, "
    "model_version string, label string, score double, created_at timestamp"
)
REVIEW_EMBEDDINGS = (
    "id string, organization_id string, product_id string, review_id string, model_name string, "
    "model_version string, embedding array<float>, created_at timestamp"
)

# Uniqueness rules per table (a NULL in a key never violates).
UNIQUE_KEYS = {
    "organizations": [("slug",)],
    "users": [("auth_subject",), ("email",)],
    "memberships": [("organization_id", "user_id")],
    "products": [("organization_id", "key"), ("id", "organization_id")],
    "sources": [("id", "product_id", "organization_id"), ("product_id", "source_type", "external_reference")],
    "reviews": [("source_id", "external_id"), ("id", "organization_id")],
    "review_sentiments": [("review_id", "model_version")],
    "review_embeddings": [("review_id", "model_version")],
}

# Composite foreign keys as child -> [(child columns, parent, parent columns)].
FOREIGN_KEYS = {
    "memberships": [
        (("organization_id",), "organizations", ("id",)),
        (("user_id",), "users", ("id",)),
    ],
    "products": [(("organization_id",), "organizations", ("id",))],
    "sources": [(("product_id", "organization_id"), "products", ("id", "organization_id"))],
    "reviews": [
        (("product_id", "organization_id"), "products", ("id", "organization_id")),
        (("source_id", "product_id", "organization_id"), "sources", ("id", "product_id", "organization_id")),
    ],
    "import_jobs": [
        (("product_id", "organization_id"), "products", ("id", "organization_id")),
        (("source_id", "product_id", "organization_id"), "sources", ("id", "product_id", "organization_id")),
    ],
    "review_sentiments": [
        (("review_id", "organization_id"), "reviews", ("id", "organization_id")),
        (("product_id", "organization_id"), "products", ("id", "organization_id")),
    ],
    "review_embeddings": [
        (("review_id", "organization_id"), "reviews", ("id", "organization_id")),
        (("product_id", "organization_id"), "products", ("id", "organization_id")),
    ],
}

# Enum domain, NOT NULL columns and maximum text length per table.
DOMAINS = {
    "organizations": {"status": ORGANIZATION_STATUSES},
    "memberships": {"role": MEMBERSHIP_ROLES},
    "products": {"status": PRODUCT_STATUSES},
    "sources": {"source_type": SOURCE_TYPES},
    "reviews": {"status": REVIEW_STATUSES},
    "import_jobs": {"source_format": IMPORT_FORMATS, "status": IMPORT_JOB_STATUSES},
    "review_sentiments": {"label": SENTIMENT_LABELS},
}
NOT_NULL = {
    "organizations": ("name", "slug", "status"),
    "users": ("auth_subject", "email", "is_active"),
    "memberships": ("organization_id", "user_id", "role"),
    "products": ("organization_id", "name", "key", "default_language", "timezone", "status"),
    "sources": ("organization_id", "product_id", "name", "source_type"),
    "reviews": (
        "organization_id", "product_id", "source_id", "language", "text_redacted", "text_normalized",
        "content_hash", "occurred_at", "status",
    ),
    "import_jobs": (
        "organization_id", "product_id", "source_id", "object_key", "source_format", "status", "attempts",
    ),
    "review_sentiments": (
        "organization_id", "product_id", "review_id", "model_name", "model_version", "label", "score",
    ),
    "review_embeddings": (
        "organization_id", "product_id", "review_id", "model_name", "model_version", "embedding",
    ),
}
MAX_LENGTHS = {
    "organizations": {"name": 200, "slug": 100},
    "users": {"auth_subject": 255, "email": 320, "display_name": 200},
    "products": {"name": 200, "key": 100, "description": 2000, "default_language": 16, "timezone": 64},
    "sources": {"name": 200, "external_reference": 512, "configuration_ref": 512},
    "reviews": {"external_id": 512, "language": 16, "content_hash": 64},
    "import_jobs": {"object_key": 1024},
    "review_sentiments": {"model_name": 100, "model_version": 100},
    "review_embeddings": {"model_name": 100, "model_version": 100},
}
RANGES = {"reviews": {"rating": (1, 5)}}

# Children to clean when a row of the parent goes, as parent -> [(child, child column)].
CASCADES = {
    "organizations": [("memberships", "organization_id"), ("products", "organization_id")],
    "users": [("memberships", "user_id")],
    "products": [
        ("sources", "product_id"), ("reviews", "product_id"), ("import_jobs", "product_id"),
        ("review_sentiments", "product_id"), ("review_embeddings", "product_id"),
    ],
    "sources": [("reviews", "source_id"), ("import_jobs", "source_id")],
    "reviews": [("review_sentiments", "review_id"), ("review_embeddings", "review_id")],
}
