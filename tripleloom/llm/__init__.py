"""Operators for text corpora of language models.  Nothing else in the library imports this package."""
