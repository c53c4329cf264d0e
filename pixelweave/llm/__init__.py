"""Operators that prepare training data: packing, deduplication, scoring, mixing and scans.

Nothing else in the library imports this subpackage.
"""
