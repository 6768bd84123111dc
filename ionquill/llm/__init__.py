"""Training-data operators: deduplication, tokenising, quality, extraction, search, packing, archives.

Nothing outside this subpackage imports it. ``registry.queries`` and
``registry.oracle_sql`` list the queries that the entry module offers.
"""
