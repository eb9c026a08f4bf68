"""All queries of the core, with their SQL where there is one."""

from importlib import import_module

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in ("nested", "relational", "layout", "tables", "quality", "textstats", "flows"):
    _module = import_module(f"foliolake.queries.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
