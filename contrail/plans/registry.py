"""Named queries: Spark builders plus their independent SQL oracle text.

``register`` records a builder ``fn(Loyalty) -> DataFrame`` under a name and,
when the query is SQL-checkable, the DuckDB text.  Double columns are rounded
to six digits on both sides (listed in ``doubles`` for the SQL side).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.exprs import rnd
from .layers import Loyalty

DIGITS = 6

_BUILDERS: dict[str, Callable[[Loyalty], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
_DOUBLES: dict[str, list[str]] = {}
_DIGITS: dict[str, int] = {}


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (stable output for cross-engine checks)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(rnd(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def rounded_sql(sql: str, doubles: list[str], digits: int = DIGITS) -> str:
    if not doubles:
        return sql
    repl = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS q"


def register(name: str, sql: str | None = None, doubles: str | list[str] = "", digits: int = DIGITS):
    if isinstance(doubles, str):
        doubles = doubles.split()

    def deco(fn: Callable[[Loyalty], DataFrame]):
        if name in _BUILDERS:
            raise ValueError(f"duplicate query {name}")
        _BUILDERS[name] = fn
        _DOUBLES[name] = list(doubles)
        _DIGITS[name] = digits
        if sql is not None:
            _ORACLE[name] = rounded_sql(sql, list(doubles), digits)
        return fn
    return deco


def builder(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = _BUILDERS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(fn(Loyalty(spark, sf_dir)), _DIGITS[name])
    run.__name__ = name
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: builder(name) for name in _BUILDERS}


def all_oracle() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def declared_doubles() -> dict[str, list[str]]:
    _load()
    return dict(_DOUBLES)


def _load():
    # Importing the query modules fills the registry.
    import importlib
    for mod in QUERY_MODULES:
        importlib.import_module(f"{__package__}.{mod}")


QUERY_MODULES = ["q_base", "q_profiling", "q_stats", "q_aggregates", "q_windows", "q_features", "q_model", "q_insights"]
