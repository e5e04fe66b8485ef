"""Training-data operators: tokenizing, deduplication, archives, filters, search, packing.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""
