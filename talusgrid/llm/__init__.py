"""Operators for building training corpora: cleaning, deduplication, mixing and encoding of documents.

Nothing else in the library imports this subpackage.
"""
