"""Training-data operators: dedup, extraction, tokenizing, quality, language, mixing and vector search.

Nothing outside this subpackage imports it.
"""
