"""Operators for preparing training text: numbered operators and their queries.

Nothing else in the library imports this subpackage.
"""
