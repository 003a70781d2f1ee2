"""Training-data operators: quality, deduplication, scoring, packing and decontamination.

Nothing else in the library imports this subpackage.
"""
