"""Operators for preparing training text, and the queries over them.

Nothing outside this package imports it.
"""
