"""Training-data operators: scoring, deduplication, search, tokenisation, formatting and mixing."""
