"""Training-data operators: sharding, secrets, language, mixing, decontamination, deduplication, tokens, HTML and search."""
