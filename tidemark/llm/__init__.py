"""Operators for preparing training text: deduplication, scoring, filtering, mixing and packing.

Nothing else in the library imports this subpackage.
"""
