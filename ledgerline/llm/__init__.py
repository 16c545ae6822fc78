"""Training-data operators: packing, deduplication, scans, classifiers.

Nothing outside this subpackage imports it.
"""
