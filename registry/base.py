"""Registration of a query with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from registry.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The views of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register `f(tables)`.  `sql` is the body of the check; `views` become its WITH clause."""
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if views:
                joint = ",\n" if body.upper().startswith("WITH ") else "\n"
                body = body[5:] if joint.startswith(",") else body
                body = f"WITH {ctes(*views)}{joint}{body}"
            ORACLE[name] = body
        return f
    return register
