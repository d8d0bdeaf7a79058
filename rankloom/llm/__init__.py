"""Operators for training-data pipelines. The rest of the library never imports this package."""
