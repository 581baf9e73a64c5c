"""Operators for preparing training text: deduplication, formatting, scoring, filtering and tokenizing.

Nothing else in the library imports this subpackage.
"""
