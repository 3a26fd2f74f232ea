"""Training-data operators: dedup, classification, extraction, tokenizing, packing, sharding."""
