"""Training-data operators: packing, deduplication, filtering, search and chat formatting.

Nothing else in the library imports this subpackage.
"""
