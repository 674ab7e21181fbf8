"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames and returns
DataFrames; ``queries`` holds the registered ``opN_...`` queries and their SQL.

Cases every operator defines the same way: a null text counts as empty, a null id is an id like any
other, repeated rows are kept as rows of their own, an empty table gives an empty table, and columns
an operator does not name are ignored (or passed on, where it filters rows).
"""
