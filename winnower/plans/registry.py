"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Roles:
    """The views over one folder of tables, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Registers ``f(roles)``; the named double columns are rounded to six digits on both sides."""

    def add(f: Callable[[Roles], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Roles(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in doubles.split()}) if doubles else df

        QUERIES[name] = run
        if sql:
            full = with_views(sql)
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in doubles.split())}) FROM ({full})" if doubles else full
        return f

    return add
