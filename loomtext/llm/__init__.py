"""Training-data operators: dedup, quality, mixing, packing, media, PII, chat and archive fixity."""
