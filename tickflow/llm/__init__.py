"""Training-data operators: tokenizing, filtering, deduplication, packing.

Ten operators and their queries.  Nothing else in the library imports this
subpackage; it imports only general helpers of the library.
"""
