"""Operators of a training-data pipeline, one module each, on Spark DataFrames.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; every operator also has a general interface of its own.
"""
