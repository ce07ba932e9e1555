"""Registered queries: each applies operators to the given tables, with a SQL twin where SQL can say it."""
