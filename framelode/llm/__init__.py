"""Operators of a training-data pipeline, one module each.

Nothing else in the package imports this subpackage.
"""
