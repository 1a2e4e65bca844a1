"""Training-data operators: similarity joins, search, deduplication, scoring, masking and mixing of large corpora."""
