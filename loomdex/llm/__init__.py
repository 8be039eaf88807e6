"""Operators that prepare text, code and vectors for language models.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
