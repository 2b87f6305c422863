"""Registered queries over the benchmark's tables, with their SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from vergraph.plans import queries_data, queries_graph, queries_more, queries_rest, queries_sync

    return queries_data, queries_graph, queries_sync, queries_rest, queries_more


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["tol1_devices_in_room"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}
