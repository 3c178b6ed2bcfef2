"""Training-data operators: language id, near and exact dedup, formatting, mixing, scoring, PII, token files."""
