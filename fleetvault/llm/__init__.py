"""Operators for preparing training text, images of pages and vectors."""
