"""Operators of a large-scale text-corpus pipeline.

Nothing else in the library imports this subpackage.
"""
