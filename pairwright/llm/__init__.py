"""Training-data operators: archives, deduplication, privacy, packing, tokens, quality, extraction."""
