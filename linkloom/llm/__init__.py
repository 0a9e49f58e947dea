"""Training-data operators: dedup, search, packing, filtering, mixing, scoring.

The rest of the library does not depend on this subpackage.
"""
