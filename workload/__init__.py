"""Queries of the library on the given tables, and the SQL they are checked against."""
