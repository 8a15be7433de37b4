"""Training-data operators: deduplication, archives, language, quality, tokens.

Nothing outside this package imports it.
"""
