"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
# Named SQL fragments; a query's SQL lists by name the fragments it reads.
FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    if name in FRAGMENTS:
        raise ValueError(f"fragment {name} is defined twice")
    FRAGMENTS[name] = sql


def with_fragments(final: str) -> str:
    """Prefix ``final`` with the fragments it needs, each after the ones it reads itself."""
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in FRAGMENTS and word not in ordered and word not in path:
                visit(FRAGMENTS[word], path + (word,))
                ordered.append(word)

    visit(final, ())
    if not ordered:
        return final
    body = ",\n".join(f"{n} as materialized ({FRAGMENTS[n]})" for n in ordered)
    return f"with {body}\n{final}"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder); ``sql`` is its DuckDB equivalent, if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return register


def draw_sql(*parts: str) -> str:
    """SQL twin of ``functions.hashing.draw`` over SQL expressions."""
    return f"('0x' || substr(md5(concat_ws(',', {', '.join(parts)})), 1, 8))::BIGINT"


def load() -> dict[str, Query]:
    from tidemark.plans import core, evaluation, experiments, features, models, sequences  # noqa: F401

    return QUERIES
