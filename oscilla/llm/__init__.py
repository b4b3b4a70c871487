"""Operators that prepare text corpora for language-model training.

Nothing outside this package imports it, and it imports nothing of the rest of
the library, so that it can be removed as a whole.
"""
