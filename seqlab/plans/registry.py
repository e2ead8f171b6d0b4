"""Named queries, each with the SQL that states the same result on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.plans.fragments import FRAGMENTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fragments(sql)
        return fn

    return register


def with_fragments(body: str) -> str:
    """Prefix ``body`` with the common table expressions it mentions, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, fragment in FRAGMENTS.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                visit(fragment)

    visit(body)
    parts = [f"{name} AS ({FRAGMENTS[name]})" for name in FRAGMENTS if name in needed]
    if not parts:
        return body
    body = body.strip()
    recursive = "RECURSIVE " if body.startswith("RECURSIVE") else ""
    if body.startswith("RECURSIVE "):
        body = body[len("RECURSIVE "):]
    if body.startswith("WITH "):
        return f"WITH {recursive}{', '.join(parts)}, {body[5:]}"
    return f"WITH {recursive}{', '.join(parts)} {body}"


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None


def r6(c: Column | str) -> Column:
    """Six places, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
