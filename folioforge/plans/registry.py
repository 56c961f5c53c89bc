"""Registration of named queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.plans.oracle_views import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(
    name: str, needs: tuple[str, ...] = (), sql: str | None = None, extra: dict | None = None,
    days: tuple[str, ...] = (),
):
    """Register a query builder; ``sql`` is composed over the views in ``needs``.

    ``days`` are the date columns, which are compared in ISO form.
    """

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            text = sql
            if days:
                casts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in days)
                text = f"SELECT * REPLACE ({casts}) FROM ({sql.strip()}) dated"
            ORACLE[name] = compose(text, *needs, extra=extra)
        return fn

    return register


def show(df: DataFrame, **digits: int) -> DataFrame:
    """Comparable output: decimals as doubles, ints as longs, dates in ISO form, and named columns rounded."""
    out = []
    for name, dtype in df.dtypes:
        col = F.col(f"`{name}`")
        if dtype.startswith("decimal") or dtype == "float":
            col = col.cast("double")
        elif dtype in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        elif dtype == "date":
            col = col.cast("string")
        if name in digits:
            col = F.round(col.cast("double"), digits[name])
        out.append(col.alias(name))
    return df.select(*out)
