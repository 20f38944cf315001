"""Operators for training-data pipelines. Nothing else in this library imports them."""
