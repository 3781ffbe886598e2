"""Operators for training-data pipelines over source code and text; nothing else in the package imports this."""
