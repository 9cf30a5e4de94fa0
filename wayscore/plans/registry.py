"""Query registry: a name, a typed column list, a Spark plan and the SQL that checks it.

The column list drives both sides. ``l`` is a 64-bit integer, ``d`` a double
rounded to six places, ``s`` a string and ``b`` a boolean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore.functions.numeric import rounded6
from wayscore.plans.views import SQL_VIEWS, VIEW_DEPS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, list[str]] = {}

_SPARK = {"l": "long", "d": "double", "s": "string", "b": "boolean"}
_DUCK = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def _spec(text: str) -> list[tuple[str, str]]:
    return [(p[:-2], p[-1]) if p[-2:-1] == ":" else (p, "d") for p in text.split()]


def shape(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, t in _spec(cols):
        c = F.col(name).cast(_SPARK[t])
        out.append((rounded6(c) if t == "d" else c).alias(name))
    return df.select(*out)


def _with_views(views: str, sql: str, cols: str) -> str:
    wanted: list[str] = []

    def add(v: str) -> None:
        for dep in VIEW_DEPS.get(v, ()):
            add(dep)
        if v not in wanted:
            wanted.append(v)

    for v in views.split():
        add(v)
    ctes = [f"{v} AS ({SQL_VIEWS[v]})" for v in wanted]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        head, sql = "WITH RECURSIVE ", sql[len("WITH RECURSIVE"):].strip()
    elif sql.upper().startswith("WITH"):
        head, sql = "WITH ", sql[len("WITH"):].strip()
    else:
        head, sql = "WITH ", "final_rows AS (" + sql + ") SELECT * FROM final_rows"
    # the last top-level SELECT stays the body: wrap it as a subquery
    inner = head + ", ".join([*ctes, sql])
    outs = []
    for name, t in _spec(cols):
        if t == "d":
            outs.append(f"floor(CAST({name} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {name}")
        else:
            outs.append(f"CAST({name} AS {_DUCK[t]}) AS {name}")
    return f"SELECT {', '.join(outs)} FROM ({inner}) AS shaped"


def query(name: str, ops: str, cols: str, views: str = "", sql: str | None = None):
    """Register a query under ``name`` for the operators listed in ``ops``."""

    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), cols)
        OPERATORS[name] = ops.split()
        if sql is not None:
            ORACLES[name] = _with_views(views, sql, cols)
        return fn

    return wrap
