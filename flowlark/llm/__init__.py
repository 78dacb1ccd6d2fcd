"""Training-data operators: deduplication, tokenising, packing, search, scoring, archives, privacy."""
