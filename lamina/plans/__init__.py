"""Derived repositories over the supplied tables, the queries on them and their SQL twins."""
