"""Training-data operators: deduplication, similarity joins, tokenisation, quality, mixing, licences."""
