"""Operators for preparing training data: de-duplication, tokens, language, privacy, packing, web archives."""
