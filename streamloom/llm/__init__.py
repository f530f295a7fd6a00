"""Training-data operators: language, near and exact copies, personal data, mixing, tokens, quality.

Nothing else in the library imports this subpackage; its queries are in ``queries``.
"""
