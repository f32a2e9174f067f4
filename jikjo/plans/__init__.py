"""Queries: which operators run over which tables, and the SQL that gives the same rows."""
