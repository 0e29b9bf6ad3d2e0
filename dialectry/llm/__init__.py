"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
