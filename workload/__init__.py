"""Catalogue relations derived from the given tables, the registered queries and their SQL."""
