"""Operators for large training-text pipelines; nothing else in wordmill imports this subpackage."""
