"""Training-data operators: filters, deduplication, mixing, sharding, scans.

Nothing outside this package imports it; it can be deleted as a whole.
"""
