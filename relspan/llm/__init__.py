"""Operators of a training-data pipeline over document tables.

Nothing else in the package imports this subpackage.
"""
