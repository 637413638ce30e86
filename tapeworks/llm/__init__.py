"""Operators of a training-data pipeline: filtering, search, dedup, packing, tokenizing.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
