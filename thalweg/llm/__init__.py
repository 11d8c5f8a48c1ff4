"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage.
"""
