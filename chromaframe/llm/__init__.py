"""Operators for large training corpora: deduplication, decontamination, tokens, packing, scoring.

Nothing outside this subpackage imports it; ``registry`` holds its queries and their SQL.
"""
