"""Training-data operators: extraction, dedup, formatting, scoring, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
