"""Readers and writers of the catalogue relations."""
