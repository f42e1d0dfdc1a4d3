"""Named queries over the driver tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables and views of one data folder by attribute: ``t.orders``, ``t.v_jobs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name][0])
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """SQL in which {name} stands for a table or view."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def expanded(sql: str) -> str:
    """Oracle SQL with the views it names ({v_jobs}) put in front as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name][1])
                order.append(name)

    visit(sql)
    plain = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    if not order:
        return plain
    views = ",\n".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n][1]).strip()})" for n in order)
    if plain.upper().startswith("WITH "):
        return f"WITH {views},\n{plain[5:]}"
    return f"WITH {views}\n{plain}"


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(t: Tables) -> DataFrame`` under ``name``, with its oracle SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = expanded(sql)
        return f

    return add
