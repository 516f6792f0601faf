"""All registered queries of the library's own operators and their SQL oracles."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "claim_admission"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, with the SQL that gives the same rows."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


for _module in ("text", "values", "matching", "intake", "rollups", "ranking", "dedup", "graph", "entries", "drafts", "boards", "sources", "streams", "reports", "commitments", "pages", "board_tables"):
    import_module(f"attestra.plans.{_module}")
