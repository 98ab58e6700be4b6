"""Operators for cleaning, filtering and mixing text corpora. Nothing else in the library imports this subpackage."""
