"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metricwatch.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Common table expressions over the given tables.
CTE = {
    "raw": (
        "SELECT event_type AS series_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id "
        "FROM events"
    ),
    "pts": "SELECT series_id, ts, arg_max(value, event_id) AS value FROM raw GROUP BY 1, 2",
    "idx": (
        "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn, "
        "count(*) OVER (PARTITION BY series_id) AS n FROM pts"
    ),
    "daily": (
        "SELECT o_orderpriority AS series_id, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS ts, "
        "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value "
        "FROM orders GROUP BY 1, 2"
    ),
    "didx": (
        "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn, "
        "count(*) OVER (PARTITION BY series_id) AS n FROM daily"
    ),
}
NEEDS = {"raw": (), "pts": ("raw",), "idx": ("pts",), "daily": (), "didx": ("daily",)}


def with_ctes(*names_and_pairs: str | tuple[str, str]) -> str:
    """`WITH ...` text: names come from CTE with what they need, pairs are (name, select)."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        done.setdefault(name, CTE[name])

    for item in names_and_pairs:
        if isinstance(item, str):
            add(item)
        else:
            done[item[0]] = item[1]
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in done.items()) + "\n"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL it must match if there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
