"""Operators for training-data pipelines (quality, media, near-dedup, packing, ...).

Nothing else in the library imports this subpackage.
"""
