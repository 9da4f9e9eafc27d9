"""Training-data operators: deduplication, extraction, tokenizing, scoring, packing."""
