"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. ``registry.queries()``
and ``registry.oracle_sql()`` list its queries and their DuckDB twins.
"""
