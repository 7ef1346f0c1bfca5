"""Operators for preparing training data for language models.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
