"""Training-data operators: language ID, LM scoring, fingerprints, dedup, mixing, packing."""
