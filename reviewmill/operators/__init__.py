"""DataFrame operators: validation, dedup, joins, aggregation, models, search."""
