"""Operators for preparing training text: quality, language, tokens, duplicates, packing."""
