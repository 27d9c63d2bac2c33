"""Operators for training-data pipelines; nothing else in docframe imports this subpackage."""
