"""Training-data operators: cleaning, fingerprints, deduplication, sharding, language ID, mixing, WARC, packing, secrets."""
