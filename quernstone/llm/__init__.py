"""Training-data operators: deduplication, packing, filtering, scoring, mixing.

Nothing else in the library imports this subpackage.
"""
