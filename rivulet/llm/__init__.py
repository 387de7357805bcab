"""Operators of a training-data pipeline over tables of documents and web pages.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, reads only the columns it names and leaves all others alone, so
extra columns, also with clashing names, do no harm.
"""
