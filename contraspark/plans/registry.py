"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Tables that the query being built has made so far.
_MADE: ContextVar[dict[tuple, DataFrame] | None] = ContextVar("made", default=None)


def once(key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``make`` returns, made at most once while a registered query is built."""
    made = _MADE.get()
    if made is None:
        return make()
    if key not in made:
        made[key] = make()
    return made[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read once for a query."""
    return once(("table", sf_dir, name), lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, and -0.0 made 0.0: sums of a distributed table are not made in a fixed order."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = (), digits: int = 9):
    """Register a query; ``doubles`` are the columns of the SQL that are rounded like the query's, to fewer ``digits`` where the two solve an equation."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            token = _MADE.set({})
            try:
                return rounded(fn(spark, sf_dir), digits)
            finally:
                _MADE.reset(token)

        QUERIES[name] = run
        if sql is not None:
            cols = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles)
            ORACLE_SQL[name] = sql if not doubles else f"SELECT * REPLACE ({cols}) FROM ({sql})"
        return fn

    return put
