"""All queries of the engine by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lemmaforge.plans import bags, corpus, papers, retrieval, streams

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (retrieval, bags, corpus, papers, streams)


def queries() -> dict[str, Query]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
