"""Operators for preparing training data, one module for each.

Nothing outside this subpackage imports it.
"""
