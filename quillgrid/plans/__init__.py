"""Queries of the catalogue by theme; each module has QUERIES and ORACLE_SQL."""
