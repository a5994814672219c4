"""Training-data operators: scans, fingerprints, packing, deduplication, output, filtering, mixing.

Nothing outside this package imports it; the folder can be removed and the rest still works.
"""
