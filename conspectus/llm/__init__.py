"""Training-data operators: dedup, packing, extraction, mixing, archives, quality and secrets.

Nothing outside this subpackage imports it.
"""
