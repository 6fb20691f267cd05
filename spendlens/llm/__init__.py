"""Training-data operators: search, scans, deduplication, tokenisation, output.

Nothing else in the library imports this subpackage.
"""
