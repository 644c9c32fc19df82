"""Operators of a training-data pipeline over documents, pages and vectors.

Each module holds one operator with a general interface; ``queries`` binds
them to the given tables. Nothing outside this folder imports it.
"""
