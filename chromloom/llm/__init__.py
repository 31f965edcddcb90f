"""Operators for the preparation of training text and media. Nothing else in the library imports this subpackage."""
