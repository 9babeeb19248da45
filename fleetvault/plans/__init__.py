"""Decisions over the whole catalogue: what to upload, check, restore or purge."""
