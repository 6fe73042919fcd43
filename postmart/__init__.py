"""Post-archive and strategy-run analytics as plain DataFrame operations.

Sub-packages
------------
``functions``  column expressions (parsing, keys, labels)
``sources``    readers for landed payloads, JSON lines, CSV and HTML tables
``operators``  DataFrame-in, DataFrame-out relational operators
``plans``      whole queries and jobs composed from the operators
``sinks``      distributed writers with publish-when-complete semantics
``streaming``  incremental ingestion and stateful run tracking
"""
