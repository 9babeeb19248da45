"""Backup catalogue and storage-usage analytics as plain DataFrame transformations.

* ``functions``  column expressions: paths, names, times, sizes, records, checksums
* ``operators``  set-wise building blocks: listings, gates, manifests, usage, history
* ``plans``      decisions made by joining the catalogue: upload, validate, restore, retention
* ``sources``    readers and writers: inventories, manifests, file metadata, transfer logs, content
* ``streaming``  change events, component lifetimes and hourly sums as Structured Streaming jobs

Everything runs over all hosts, keyspaces and backups at once.
"""
