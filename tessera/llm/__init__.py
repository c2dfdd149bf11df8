"""Operators for text corpora: quality, language, tokens, fingerprints, near copies, mixing, licences, search."""
