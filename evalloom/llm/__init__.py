"""Training-data operators: packing, archives, token files, near duplicates, mixing, filters.

Nothing outside this subpackage imports it.
"""
