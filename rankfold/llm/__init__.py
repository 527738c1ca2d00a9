"""Training-data operators: mixing, redaction, extraction, de-duplication, quality, token counts, sharding."""
