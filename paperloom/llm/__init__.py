"""Operators for preparing large text corpora.

Every module here is self-contained: nothing outside this subpackage imports
it, and it imports nothing from the rest of the library.  Each operator takes
DataFrames and returns DataFrames; ``queries`` holds the thin ``opN_*`` queries
that apply them to whole tables.
"""
