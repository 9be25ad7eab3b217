"""Query catalogue: one DataFrame plan per operator, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry import session

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}

MODULES = ("sources", "columns", "joins", "aggregates", "ordered", "models")


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its operator id."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def with_views(*views: str, body: str) -> str:
    return f"WITH {', '.join(views)} {body}"


def r6(column: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, so that summation order does not show."""
    column = F.col(column) if isinstance(column, str) else column
    rounded = F.round(column, 6)
    return rounded.alias(name) if name else rounded


def n_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def load_all() -> None:
    for name in MODULES:
        import_module(f"posequarry.plans.queries_{name}")


_written: dict[tuple[str, str, str], str] = {}


def written_once(spark: SparkSession, folder: str, name: str, build: Callable[[str], object]) -> str:
    """Scratch path of a table built once per session and input folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        path = session.scratch_path(spark, name)
        build(path)
        _written[key] = path
    return _written[key]
