"""Training-data operators: quality, deduplication, tokens, personal data, secrets, decontamination."""
