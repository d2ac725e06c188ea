"""Operators for preparing training data: filters, duplicates, mixing, packing, search.

Nothing outside this subpackage imports it.
"""
