"""Operators and a pipeline for preparing training data; nothing else in the library imports this."""
