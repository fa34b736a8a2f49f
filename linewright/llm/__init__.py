"""Operators for text corpora: dedup, extraction, language, quality, privacy, tokens, shards."""
