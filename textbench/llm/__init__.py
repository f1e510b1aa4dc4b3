"""Training-data operators: filtering, deduplication, tokenisation, scoring.

Nothing else in the library imports this package; it may be deleted whole.
"""
