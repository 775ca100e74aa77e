"""Read plans over audit tables, reports, and the registry of queries with their SQL."""
