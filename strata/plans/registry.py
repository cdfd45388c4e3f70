"""Registry of named queries: a Spark plan and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.plans.views import VIEW_SQL

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; `sql` may start from any fixture view by naming it."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = doubles(with_views(sql))
        return plan

    return register


def doubles(sql: str) -> str:
    """Write decimal literals as doubles (0.5 -> 0.5e0), so both engines compute in doubles."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if p.startswith("'") else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for p in parts)


def with_views(sql: str) -> str:
    """Put the definitions of the fixture views `sql` mentions in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view, body in VIEW_SQL.items():
            if view not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{view}\b", text):
                visit(body)
                needed.append(view)

    visit(sql)
    if not needed:
        return sql
    definitions = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in needed)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive:
        body = ", " + body[len("WITH RECURSIVE "):]
    elif body.upper().startswith("WITH "):
        body = ", " + body[len("WITH "):]
    return f"WITH {'RECURSIVE ' if recursive else ''}{definitions}\n{body}"
