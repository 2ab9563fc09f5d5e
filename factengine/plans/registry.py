"""Registered queries and their checking SQL.

A query is a function of a ``Tables`` object, which reads tables and views
lazily. Its SQL may name the views of ``projection.VIEWS``; those it needs are
put in front as common table expressions.
"""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: HotSpot never compiles a method of more bytecode than this; Spark then takes projections that it splits into small methods.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", 8000)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a folder by name, and the model views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        name, most = METHOD_LIMIT
        if int(spark.conf.get(name)) > most:  # a setting of the session; a smaller one stays
            spark.conf.set(name, str(most))

    def __getattr__(self, name: str) -> DataFrame:
        from .projection import VIEWS

        if name in VIEWS:
            found = VIEWS[name][0](self)
        else:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, found)
        return found


def with_views(sql: str) -> str:
    from .projection import VIEWS

    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(VIEWS[name][1])
                needed.append(name)

    need(sql)
    head = ",\n".join(f"{n} as materialized ({VIEWS[n][1]})" for n in needed)
    if not head:
        return sql
    body = sql.strip()
    return f"with {head}{', ' + body[5:] if body[:5].lower() == 'with ' else ' ' + body}"


def query(name: str, sql: str | None = None):
    """Register f(tables) -> DataFrame under name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return f

    return add
