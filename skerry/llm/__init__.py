"""Operators for language-model corpora. Nothing else in the library imports this subpackage."""
