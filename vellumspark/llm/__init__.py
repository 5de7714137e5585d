"""Training-data operators: scoring, sharding, counting, deduplication, filtering, packing."""
