"""Training-data operators: mixing, deduplication, classification, packing and token output.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries.
"""
