"""Training-data operators: deduplication, packing, search, extraction, scoring.

``catalog.queries()`` and ``catalog.oracle_sql()`` list the registered queries.
Nothing outside this subpackage imports it.
"""
