"""Registered queries: a name, a function of the bound tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import SQL_TABLES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(tables). sql may use the bound tables of bindings.SQL_TABLES; rows only are checked without it."""

    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            own = sql.strip()
            recursive = "RECURSIVE " if own.upper().startswith("WITH RECURSIVE ") else ""
            own = own[5 + len(recursive):] if own.upper().startswith("WITH ") else None
            ORACLE[name] = f"WITH {SQL_TABLES}\n{sql.strip()}" if own is None else f"WITH {recursive}{SQL_TABLES},\n{own}"
        return fn

    return keep
