"""Operators for preparing language-model training data.

Nothing outside this package imports it; it can be removed as a whole.
"""
