"""Training-data operators: scoring, counting, near-duplicate search, encoding, sharding and archives.

Nothing outside this package imports it. `registry.queries()` lists its queries.
"""
