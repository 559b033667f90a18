"""Operators for large training-data pipelines; nothing else in weft imports this."""
