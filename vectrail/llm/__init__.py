"""Operators for preparing training text at scale.

``queries()`` and ``oracle_sql()`` list what this subpackage registers.
"""

from vectrail.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
