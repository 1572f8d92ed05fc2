"""Training-data operators: deduplication, filtering, scoring, mixing and tokenising.

Nothing outside this subpackage imports it.
"""
