"""Training-data operators: dedup, fingerprints, language, mixing, extraction,
licences, shards and tokens. Nothing else in the library imports this package."""
