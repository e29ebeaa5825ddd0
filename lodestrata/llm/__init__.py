"""Operators that prepare text and vector collections for training data.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
