"""Training-data operators: tokenising, filtering, deduplicating, searching and mixing corpora."""
