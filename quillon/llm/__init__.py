"""Operators for large training-corpus pipelines; nothing else in the library imports this subpackage."""
