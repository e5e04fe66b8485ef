"""Ranks and running sums of any length of key: no window goes over more rows than one sorted range holds.

Rows are partitioned by range of key and order, and sorted inside each range. A row's rank or sum is that
inside its range plus the totals of the ranges before with the same key; these totals are one row for each
range and key. A key that holds all rows spans many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraspark.sources.storage import keep

_PART_BITS = 33


def running(df: DataFrame, key: list[str], order: list[Column | str], sums: dict[str, Column] | None = None, rank: str = "k", total: str | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 1, by ``order`` in the key), the running totals ``sums``, and, if named, the rows of the key as ``total``.

    ``before`` gives values of the row before in the same key (null for the first). Rows equal in ``order``
    take any order. Null keys are a key. Columns whose names begin with ``_r_`` are used inside.
    """
    sums, before = dict(sums or {}), dict(before or {})
    named = {f"_r_s{i}": c for i, c in enumerate(sums.values())} | {f"_r_b{i}": c for i, c in enumerate(before.values())}
    keys = [F.col(c) for c in key] or [F.lit(0)]
    made = df.withColumns(named | {f"_r_k{i}": c for i, c in enumerate(keys)})
    own = [f"_r_k{i}" for i in range(len(keys))]
    by = [*own, *order]
    made = keep(made.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_r_id", F.monotonically_increasing_id()), "ranges")
    made = made.withColumn("_r_part", F.shiftright("_r_id", _PART_BITS))
    inside = Window.partitionBy("_r_part", *own).orderBy("_r_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns({"_r_n": F.row_number().over(inside)} | {f"_r_t{i}": F.sum(f"_r_s{i}").over(upto) for i in range(len(sums))} | {f"_r_l{i}": F.lag(f"_r_b{i}").over(inside) for i in range(len(before))})
    # One row for each range and key, with the last values for the first row of the next range.
    last = lambda c: F.max_by(c, "_r_id").alias(c)
    parts = made.groupBy("_r_part", *own).agg(F.count("*").alias("_r_rows"), *[F.sum(f"_r_s{i}").alias(f"_r_s{i}") for i in range(len(sums))], *[last(f"_r_b{i}") for i in range(len(before))])
    ranges = Window.partitionBy(*own)
    earlier = ranges.orderBy("_r_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = parts.select(
        F.col("_r_part").alias("_r_p"), *[F.col(c).alias(f"{c}_") for c in own], zero(F.sum("_r_rows").over(earlier)).alias("_r_on"), F.sum("_r_rows").over(ranges).alias("_r_all"),
        *[zero(F.sum(f"_r_s{i}").over(earlier)).alias(f"_r_os{i}") for i in range(len(sums))], *[F.lag(f"_r_b{i}").over(ranges.orderBy("_r_part")).alias(f"_r_ob{i}") for i in range(len(before))],
    )
    on = [F.col("_r_part") == F.col("_r_p")] + [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in own]
    j = made.join(offsets, on)
    out = {rank: F.col("_r_n") + F.col("_r_on")} | ({total: F.col("_r_all")} if total else {})
    out |= {name: F.col(f"_r_t{i}") + F.col(f"_r_os{i}") for i, name in enumerate(sums)}
    out |= {name: F.when(F.col("_r_n") > 1, F.col(f"_r_l{i}")).otherwise(F.col(f"_r_ob{i}")) for i, name in enumerate(before)}
    return j.select(*[c for c in df.columns if c not in out], *[c.alias(name) for name, c in out.items()])


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with each row's place by ``order``, from ``start``."""
    return running(df, [], order, rank=name).withColumn(name, F.col(name) - 1 + start)
