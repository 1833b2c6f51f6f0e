"""Operators for large text corpora. Nothing else in gridloom imports this subpackage."""
