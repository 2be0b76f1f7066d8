"""Registry of checked queries: a Spark callable and its equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    """A named SQL fragment that later statements may refer to."""
    _CTES[name] = text


def statement(body: str) -> str:
    """``body`` (which may start with its own CTEs) after the fragments it names."""
    used, text = [], body
    for name in reversed(_CTES):
        if re.search(rf"\b{name}\b", text):
            used.insert(0, f"{name} AS ({_CTES[name]})")
            text += "\n" + _CTES[name]
    body = body.strip()
    if not used:
        return body
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(used) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(used) + ",\n" + body[5:]
    return "WITH " + ",\n".join(used) + "\n" + body


def query(name: str, sql: str | None = None):
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = statement(sql)
        return run

    return keep


def R(expr: str, digits: int) -> str:
    """Half-even rounding to double, without negative zero."""
    return f"(round_even(CAST(({expr}) AS DOUBLE), {digits}) + 0e0)"
