"""Operators that turn raw text tables into training data, one module each.

Nothing outside this subpackage imports it.  ``registry`` holds the queries.
"""
