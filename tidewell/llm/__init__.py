"""Training-data operators: sharding, media, decontamination, tokens, secrets, dedup, toxicity."""
