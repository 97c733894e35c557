"""Training-data operators: mixing, filtering, deduplication, extraction, formatting."""
