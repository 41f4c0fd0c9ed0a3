"""Operators of a training-data pipeline: mixing, fingerprints, tokens, near copies, search, language, archives, filters, quality."""
