"""Paired losses of a rule and a shared strategy: weighted means, cluster errors, ratio intervals and adoption."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraspark.operators.inference import hash_int
from contraspark.operators.student import with_t_quantile

#: A unit with more than this share of all weight, or fewer units than this, is worth a warning.
LARGE_SHARE, FEW_UNITS = 0.25, 10


def unit_sums(df: DataFrame, key: list[str], shared: str, rule: str, weight: str, unit: str) -> DataFrame:
    """Per unit its weight and weighted sums of shared loss and improvement; ``bad`` counts rows that are no paired losses.

    Losses must be finite and not negative, weights finite and positive, units named.
    """
    usable = lambda c, least: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) < float("inf")) & least
    good = usable(shared, F.col(shared) >= 0) & usable(rule, F.col(rule) >= 0) & usable(weight, F.col(weight) > 0) & F.coalesce(F.col(unit).cast("string") != "", F.lit(False))
    s, d, w = F.col(shared), F.col(shared) - F.col(rule), F.col(weight)
    g = df.withColumn("_good", F.coalesce(good, F.lit(False))).groupBy(*key, unit)
    return g.agg(F.count("*").alias("rows"), F.count_if(~F.col("_good")).alias("bad"), F.sum(w).alias("w"), F.sum(w * s).alias("ws"), F.sum(w * d).alias("wd"))


def _beside(df: DataFrame, other: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``other`` for its key; null keys meet."""
    own = other.select(*[F.col(c).alias(f"_j_{c}") for c in key], *[c for c in other.columns if c not in key])
    joined = df.join(own, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in key], F.lit(True)), how)
    return joined.drop(*[f"_j_{c}" for c in key])


def _state(lower: Column, upper: Column) -> Column:
    return F.when(lower > 0, "supported").when(upper < 0, "insufficient").otherwise("inconclusive")


def _named(state: Column) -> Column:
    return F.when(state == "supported", "beneficial").when(state == "insufficient", "harmful").otherwise("inconclusive")


def _adoption(state: Column, cost: Column) -> Column:
    return F.when((state == "supported") & (cost == "satisfied"), "supported").when((state == "insufficient") | (cost == "exceeded"), "not_supported").otherwise("inconclusive")


def paired_summary(df: DataFrame, key: list[str], shared: str, rule: str, weight: str, unit: str, target: float = 0.05, confidence: float = 0.95, least_units: int = 2,
                   shared_calls: str | None = None, rule_calls: str | None = None, cap: float = 4.0) -> DataFrame:
    """One row for each key: means, the relative reduction with its Fieller interval, the practical contrast and the improvement
    with cluster t intervals, cost and adoption.

    The covariance of the two weighted means is CR1: unit scores, times G / (G - 1). Intervals need
    ``least_units`` units. The practical contrast is (1 - target) * shared - rule. ``shared_calls`` and
    ``rule_calls`` name columns constant in a key; without them the cost is unknown. A key with a row that
    is no pair of losses is ``unassessable``: it keeps its counts and has nulls otherwise.
    """
    units = unit_sums(df, key, shared, rule, weight, unit)
    w, ws, wd = F.col("w"), F.col("ws"), F.col("wd")
    total = units.groupBy(*key).agg(F.sum("rows").alias("observations"), F.sum("bad").alias("bad"), F.sum("w").alias("tw"), F.sum("ws").alias("ts"), F.sum("wd").alias("td"))
    total = total.select(*key, "observations", F.when(F.col("bad") == 0, F.col("tw")).alias("tw"), (F.col("ts") / F.col("tw")).alias("ms"), (F.col("td") / F.col("tw")).alias("md"))
    if shared_calls is not None:
        total = _beside(total, df.groupBy(*key).agg(F.max(shared_calls).cast("double").alias("_cs"), F.max(rule_calls).cast("double").alias("_cr")), key)
    j = _beside(units, total, key).select(*total.columns, w, (ws - F.col("ms") * w).alias("us"), (wd - F.col("md") * w).alias("ud"))
    names = [c for c in total.columns if c not in key]
    g = j.groupBy(*key, *names).agg(F.count("*").alias("units"), F.sum(F.col("us") * F.col("us")).alias("ss"), F.sum(F.col("us") * F.col("ud")).alias("sd"), F.sum(F.col("ud") * F.col("ud")).alias("dd"), F.sum(w * w).alias("ww"), F.max("w").alias("wmax"))
    n = F.col("units")
    cov = lambda c: F.when((n >= 2) & F.col("tw").isNotNull(), F.col(c) * n / (n - 1) / (F.col("tw") * F.col("tw")))
    g = g.select(*key, *names, "units", (n - 1).alias("degrees"), cov("ss").alias("c00"), cov("sd").alias("c01"), cov("dd").alias("c11"), (F.col("tw") * F.col("tw") / F.col("ww")).alias("effective_units"), (F.col("wmax") / F.col("tw")).alias("largest_share"))
    g = with_t_quantile(g, F.lit((1 + confidence) / 2), "degrees", "t")
    fine = F.col("tw").isNotNull()
    g = g.withColumn("t", F.when(fine & (n >= max(2, least_units)), F.col("t"))).withColumn("ms", F.when(fine, F.col("ms"))).withColumn("md", F.when(fine, F.col("md")))
    ms, md, t = F.col("ms"), F.col("md"), F.col("t")
    contrast, spread = md - target * ms, F.sqrt(F.greatest(target * target * F.col("c00") - 2 * target * F.col("c01") + F.col("c11"), F.lit(0.0)))
    half0 = t * F.sqrt(F.col("c11"))
    # Fieller: the ratios whose contrast is within its error, a quadratic in the ratio.
    a, b, c = ms * ms - t * t * F.col("c00"), -2 * (ms * md - t * t * F.col("c01")), md * md - t * t * F.col("c11")
    disc = b * b - 4 * a * c
    status = F.when(t.isNull() | F.col("c00").isNull() | ~(ms > 0), "unavailable").when(a <= 0, "unbounded_or_disjoint").when(disc < 0, "empty_or_numerically_unstable").otherwise("finite")
    g = g.withColumn("fieller_status", status)
    root = lambda sign: F.when(F.col("fieller_status") == "finite", (-b + sign * F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * a))
    if shared_calls is None:
        cost, condition = F.lit(None).cast("double"), F.lit("unknown")
    else:
        cost = F.when((F.col("_cs") > 0) & (F.col("_cr") >= 0), F.col("_cr") / F.col("_cs"))
        condition = F.when(cost <= cap, "satisfied").when(cost > cap, "exceeded").otherwise("unknown")
    g = g.withColumn("cost_ratio", cost).withColumn("cost_condition", condition)
    g = g.withColumn("practical", F.when(ms > 0, _state(contrast - t * spread, contrast + t * spread)).otherwise("inconclusive")).withColumn("zero", _state(md - half0, md + half0))
    warn = F.array_compact(F.array(
        F.when(~fine, "unusable_rows"), F.when(n < least_units, "fewer_units_than_declared"), F.when(n < FEW_UNITS, "few_units"), F.when(ms == 0, "no_shared_loss"), F.when(F.col("largest_share") > LARGE_SHARE, "one_unit_dominates"),
    ))
    return g.select(
        *key, "observations", "units", "degrees", F.when(~fine, "unassessable").when(t.isNull(), "unavailable").otherwise("approximate").alias("interval_status"),
        ms.alias("mean_shared"), (ms - md).alias("mean_rule"), md.alias("improvement"), F.when(ms > 0, md / ms).alias("reduction"), root(-1).alias("fieller_lower"), root(1).alias("fieller_upper"), "fieller_status",
        contrast.alias("practical_contrast"), (contrast - t * spread).alias("practical_lower"), (contrast + t * spread).alias("practical_upper"), F.col("practical").alias("practical_benefit"),
        (md - half0).alias("zero_lower"), (md + half0).alias("zero_upper"), _named(F.col("zero")).alias("zero_effect"),
        "cost_ratio", "cost_condition", _adoption(F.col("practical"), F.col("cost_condition")).alias("adoption"), "effective_units", "largest_share", F.array_join(warn, ",").alias("warnings"),
    )


def leave_one_unit_out(df: DataFrame, key: list[str], shared: str, rule: str, weight: str, unit: str, target: float = 0.05) -> DataFrame:
    """Means, reduction and practical contrast without each unit, from the sums of all and of the unit; null with a single unit."""
    units = unit_sums(df, key, shared, rule, weight, unit)
    total = units.groupBy(*key).agg(F.sum("w").alias("tw"), F.sum("ws").alias("ts"), F.sum("wd").alias("td"), F.count("*").alias("units"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    j = _beside(units, total, key)
    rest = F.when(F.col("units") > 1, F.col("tw") - F.col("w"))
    j = j.withColumn("s", (F.col("ts") - F.col("ws")) / rest).withColumn("d", (F.col("td") - F.col("wd")) / rest)
    return j.select(
        *key, F.col(unit).alias("omitted_unit"), F.col("s").alias("mean_shared"), (F.col("s") - F.col("d")).alias("mean_rule"), F.col("d").alias("improvement"), F.when(F.col("s") > 0, F.col("d") / F.col("s")).alias("reduction"),
        (F.col("d") - target * F.col("s")).alias("practical_contrast"), (F.col("w") / F.col("tw")).alias("share"), (F.col("tw") * F.col("tw") / F.col("ww")).alias("effective_units"),
    )


def bootstrap_summary(df: DataFrame, key: list[str], shared: str, rule: str, weight: str, unit: str, reps: int, seed: str, target: float = 0.05, confidence: float = 0.95, least_units: int = 2,
                      shared_calls: str | None = None, rule_calls: str | None = None, cap: float = 4.0) -> DataFrame:
    """Studentized bootstrap of whole units beside the t intervals of ``paired_summary``, and the decision on which both agree.

    A draw takes as many units of its key as there are, with their weights; its pivot is (mean of the draw
    - mean) / cluster error of the draw, infinite where the draw has no spread but moved, 0 where it did
    neither. Quantiles are elements of the sorted pivots. An interval that is not finite is none.
    """
    base = paired_summary(df, key, shared, rule, weight, unit, target, confidence, least_units, shared_calls, rule_calls, cap)
    assessed = base.where(F.col("interval_status") == "approximate").select(*key, F.col("practical_contrast").alias("e1"), F.col("improvement").alias("e0"), "units")
    sums = unit_sums(df, key, shared, rule, weight, unit)
    number = F.row_number().over(Window.partitionBy(*key).orderBy(unit)) - 1  # the units of one key
    sums = sums.select(*key, "w", (F.col("wd") / F.col("w") - target * F.col("ws") / F.col("w")).alias("v1"), (F.col("wd") / F.col("w")).alias("v0"), number.alias("u"))
    per = _beside(sums, assessed, key).select(*key, "units", "u", "w", *[(F.col(f"v{i}") - F.col(f"e{i}")).alias(f"x{i}") for i in (1, 0)], F.abs("v1").alias("a1"), F.abs("v0").alias("a0"))
    slots = assessed.select(*key, "units", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select(*key, "units", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("slot"))
    u = hash_int(seed, F.col("rep").cast("string"), F.col("slot").cast("string")) % F.col("units")
    times = slots.select(*key, "rep", u.alias("u")).groupBy(*key, "rep", "u").agg(F.count("*").alias("times"))
    drawn = _beside(times, per, [*key, "u"])
    t, w = F.col("times"), F.col("w")
    of = lambda i: [F.sum(t * w * F.col(f"x{i}")).alias(f"b{i}"), F.sum(t * w * w * F.col(f"x{i}")).alias(f"e{i}"), F.sum(t * w * w * F.col(f"x{i}") * F.col(f"x{i}")).alias(f"c{i}"), (F.max(f"x{i}") - F.min(f"x{i}")).alias(f"r{i}")]
    g = drawn.groupBy(*key, "units", "rep").agg(F.sum(t * w).alias("ta"), F.sum(t * w * w).alias("th"), *of(1), *of(0))
    scale = per.groupBy(*key).agg(F.max("a1").alias("s1"), F.max("a0").alias("s0"))
    g = _beside(g, scale, key)
    n = F.col("units")

    def pivot(i: int) -> Column:
        tiny = F.greatest(F.col(f"s{i}"), F.lit(2.3e-308)) * (32 * 2.0**-52)
        m = F.col(f"b{i}") / F.col("ta")
        se = F.sqrt(F.greatest(F.col(f"c{i}") - 2 * m * F.col(f"e{i}") + m * m * F.col("th"), F.lit(0.0)) * n / (n - 1)) / F.col("ta")
        return F.when((F.col(f"r{i}") > tiny) & (se > tiny), m / se).when(m > tiny, float("inf")).when(m < -tiny, float("-inf")).otherwise(0.0)

    g = g.select(*key, "rep", pivot(1).alias("p1"), pivot(0).alias("p0"))
    low, high = math.ceil((1 - confidence) / 2 * reps - 1e-9), math.ceil((1 + confidence) / 2 * reps - 1e-9)
    rank = lambda c: F.row_number().over(Window.partitionBy(*key).orderBy(c, "rep"))  # noqa: E731  the draws of one key
    g = g.withColumn("k1", rank("p1")).withColumn("k0", rank("p0"))
    at = lambda i, k: F.max(F.when(F.col(f"k{i}") == k, F.col(f"p{i}")))
    q = g.groupBy(*key).agg(at(1, low).alias("l1"), at(1, high).alias("h1"), at(0, low).alias("l0"), at(0, high).alias("h0"))
    j = _beside(base, q, key, "left")
    # The cluster error of the whole, from the t interval's width.
    j = with_t_quantile(j, F.lit((1 + confidence) / 2), "degrees", "_t")
    width = lambda a, b: (F.col(b) - F.col(a)) / 2 / F.col("_t")
    finite = lambda a, b: [F.when((F.abs(a) < float("inf")) & (F.abs(b) < float("inf")), x) for x in (a, b)]
    lo1, up1 = finite(F.col("practical_contrast") - F.col("h1") * width("practical_lower", "practical_upper"), F.col("practical_contrast") - F.col("l1") * width("practical_lower", "practical_upper"))
    lo0, up0 = finite(F.col("improvement") - F.col("h0") * width("zero_lower", "zero_upper"), F.col("improvement") - F.col("l0") * width("zero_lower", "zero_upper"))
    j = j.withColumn("boot_lower", lo1).withColumn("boot_upper", up1).withColumn("zero_boot_lower", lo0).withColumn("zero_boot_upper", up0)
    j = j.withColumn("boot_benefit", F.when(F.col("mean_shared") > 0, _state(F.col("boot_lower"), F.col("boot_upper"))).otherwise("inconclusive"))
    j = j.withColumn("joint_benefit", F.when(F.col("boot_benefit") == F.col("practical_benefit"), F.col("boot_benefit")).otherwise("inconclusive"))
    return j.select(
        *key, "units", "practical_contrast", "improvement", "practical_lower", "practical_upper", "practical_benefit", "boot_lower", "boot_upper", "boot_benefit", "zero_boot_lower", "zero_boot_upper",
        _named(_state(F.col("zero_boot_lower"), F.col("zero_boot_upper"))).alias("zero_boot_effect"), "joint_benefit", _adoption(F.col("joint_benefit"), F.col("cost_condition")).alias("joint_adoption"),
    )
