"""Operators for preparing training corpora on Spark; nothing else in the library imports this package."""
