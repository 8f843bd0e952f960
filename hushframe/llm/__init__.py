"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator is a function
from DataFrame to DataFrame that names the columns it reads and returns its key and
its results only, so further columns of the input never clash with its own.
"""
