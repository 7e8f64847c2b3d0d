"""DataFrame operators: deduplication, scoring and selection of sentences."""
