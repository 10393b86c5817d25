"""Operators for preparing training data: deduplication, filtering, packing and sharding.

Nothing outside this package imports it.
"""
