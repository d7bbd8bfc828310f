"""Corpus preparation for language-model training: ten operators on documents and pages.

Nothing else in the package imports this subpackage.
"""
