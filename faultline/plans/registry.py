"""Registry of queries and of the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans import views
from faultline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None):
    """Registers a query. `tables` names the SQL views which `sql` reads."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(views.Tables(configure(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = views.with_views(tables, sql)
        return build

    return register
