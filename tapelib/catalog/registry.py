"""Registry of named queries and, where one exists, the equivalent SQL statement.

Both sides round doubles with the same arithmetic (``r6`` / ``R``): an offset of 1e-5 of the last kept digit
keeps values that sit exactly on a rounding boundary from depending on summation order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def r6(c, name: str | None = None) -> Column:
    e = F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.50001) / 1e6
    return e.alias(name or (c if isinstance(c, str) else "value"))


def r6s(*cols: str):
    return [r6(c) for c in cols]


def R(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.50001) / 1e6"


def Rs(*cols: str) -> str:
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (deps, body)


def sql(body: str, *needs: str, recursive: str = "") -> str:
    """Prefix ``body`` with the named CTEs and everything they depend on."""
    done: list[str] = []

    def visit(n):
        if n not in done:
            for d in CTES[n][0]:
                visit(d)
            done.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in done]
    if recursive:
        parts.append(recursive)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body
