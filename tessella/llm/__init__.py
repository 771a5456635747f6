"""Operators of a training-data pipeline: language, quality, duplicates, leaks, tokens.

Each module holds one operator with a general interface; ``registry`` holds the
thin queries over the driver's tables.  Nothing else in the library imports
this subpackage.
"""
