"""Training-data operators: search, filtering, decontamination, dedup, mixing and sharding.

Nothing outside this subpackage imports it.
"""
