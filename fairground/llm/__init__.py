"""Training-data operators: packing, deduplication, filtering, search and archives.

Nothing outside this package imports it.
"""
