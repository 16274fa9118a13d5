"""Operators for training-data pipelines over documents and pages; nothing outside imports them."""
