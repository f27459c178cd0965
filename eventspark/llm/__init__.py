"""Operators of a large-scale training-data pipeline.

Each module holds one operator; ``entry`` registers one query per operator.
Nothing else in the library imports this package.
"""
