"""Operators for preparing large text corpora as language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps extra input columns out of its way, and states in its
docstring what nulls, empty texts, repeated rows and empty tables give.
"""
