"""Names the queries of the library and keeps their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Common table expressions for the SQL: name -> (names it needs, text).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def sql_table(name: str, text: str, *needs: str) -> None:
    TABLES[name] = (needs, text)


def with_tables(text: str, needs: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in TABLES[name][0]:
                visit(n)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return text
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order) + "\n" + text


def query(sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL over the tables it needs."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_tables(sql, needs)
        return f

    return register
