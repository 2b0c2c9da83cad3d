"""Operators for preparing training text, each a DataFrame-to-DataFrame function.

Nothing outside this subpackage imports it.
"""
