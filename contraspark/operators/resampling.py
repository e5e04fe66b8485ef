"""Studentized resampling, exact tails and intervals, bounds over rules, top-k changes, recomputation checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraspark.operators.inference import complete, flip_count, schedule, sign_flips
from contraspark.operators.student import with_t_quantile


def studentized_draws(df: DataFrame, key: list[str], unit: str, value: str, reps: int, seed: str) -> DataFrame:
    """key, rep, mean0, se0, pivot: (mean of the draw - mean) / error of the draw; 0/0 is 0, x/0 is infinite. All keys share one schedule of draws.

    Keys without a finite value for every unit have no draws. A draw's error is zero exactly when it takes
    equal values alone.
    """
    times = schedule(df.select(unit).distinct(), unit, reps, seed)
    fine = complete(df, key, unit, value).where("whole").select(*key)
    g = df.join(fine, key).groupBy(*key).agg(F.avg(value).alias("mean0"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se0"))
    x = df.join(g, key).withColumn("_dev", F.col(value) - F.col("mean0"))
    t, dev = F.col("times"), F.col("_dev")
    g = x.join(times, unit).groupBy(*key, "rep", "mean0", "se0").agg(F.sum(t).alias("n"), F.sum(t * dev).alias("s"), F.sum(t * dev * dev).alias("ss"), F.min(dev).alias("lo"), F.max(dev).alias("hi"))
    m = F.col("s") / F.col("n")
    se = F.sqrt(F.greatest(F.col("ss") - F.col("s") * m, F.lit(0.0)) / (F.col("n") - 1) / F.col("n"))
    pivot = F.when((F.col("hi") > F.col("lo")) & (se > 0), m / se).when(F.col("hi") == 0, 0.0).otherwise(F.signum("hi") * F.lit(float("inf")))
    return g.select(*key, "rep", "mean0", "se0", pivot.alias("pivot"))


def max_t(draws: DataFrame, family: list[str], reps: int, level: float) -> DataFrame:
    """The element ceil(level * (reps - 1)), counted from 0, of each family's sorted largest absolute pivots."""
    top = draws.groupBy(*family, "rep").agg(F.max(F.abs("pivot")).alias("critical"))
    r = F.row_number().over(Window.partitionBy(*family).orderBy("critical", "rep"))  # the draws of one family
    return top.withColumn("r", r).where(F.col("r") == int(np.ceil(level * (reps - 1))) + 1).select(*family, "critical")


def paired_intervals(df: DataFrame, family: list[str], member: list[str], unit: str, value: str, reps: int, seed: str, confidence: float = 0.95, least_units: int = 2) -> DataFrame:
    """Simultaneous intervals of each member's mean: the envelope of Bonferroni-t and max-T bootstrap intervals.

    The multiplicity is the family's number of members, unassessable ones included; they keep a reason. The
    maximum runs over the members that can be assessed. An infinite critical value leaves its family without
    intervals.
    """
    key = [*family, *member]
    fine = complete(df, key, unit, value)
    g = df.groupBy(*key).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se")).join(fine, key)
    g = g.withColumn("_m", F.count("*").over(Window.partitionBy(*family))).withColumn("_d", F.col("units") - 1)
    ok = (F.col("se") > 0) & (F.col("se") < float("inf")) & (F.abs("mean") < float("inf"))
    reason = F.when(~F.col("whole"), "missing_unit_margin").when(F.col("units") < least_units, "insufficient_independent_units").when(F.col("se") == 0, "zero_error_without_structural_identity").when(~F.coalesce(ok, F.lit(False)), "nonfinite_sampling_statistic")
    g = with_t_quantile(g.withColumn("_why", reason), 1 - (1 - confidence) / 2 / F.col("_m"), "_d", "_t")
    active = df.join(g.where(F.col("_why").isNull()).select(*key), key)
    critical = max_t(studentized_draws(active, key, unit, value, reps, seed), family, reps, confidence)
    g = g.join(critical, family, "left")
    unbounded = F.col("critical") == float("inf")
    why = F.coalesce("_why", F.when(unbounded, "unbounded_critical_quantile"))
    half = lambda t: F.when(F.col("_why").isNull(), F.col(t) * F.col("se"))
    known = lambda c: F.when(F.col("whole"), F.col(c)).alias(c)
    t_lo, t_hi = F.col("mean") - half("_t"), F.col("mean") + half("_t")
    b_lo, b_hi = F.when(~unbounded, F.col("mean") - half("critical")), F.when(~unbounded, F.col("mean") + half("critical"))
    both = lambda f, x, y: F.when(y.isNotNull(), f(x, y))
    return g.select(
        *key, "units", known("mean"), known("se"), t_lo.alias("t_lower"), t_hi.alias("t_upper"), b_lo.alias("boot_lower"), b_hi.alias("boot_upper"),
        both(F.least, t_lo, b_lo).alias("lower"), both(F.greatest, t_hi, b_hi).alias("upper"), F.when(why.isNull(), "assessable").otherwise("unassessable").alias("status"), why.alias("reason"),
    )


def structural_zero_intervals(df: DataFrame, family: list[str], member: list[str], unit_no: str, value: str, zero: Column, n: int, level: float) -> DataFrame:
    """Sign-flip max-T intervals of each member's mean. Members that are zero by design keep the interval [0, 0] and stay out of the
    maximum; one active member without spread makes every active interval of its family infinite."""
    x = df.withColumn("structural", zero)
    flips = sign_flips(x.where("not structural"), [*family, *member], unit_no, value, n).groupBy(*family, "flip").agg(F.max("t").alias("t"))
    r = F.row_number().over(Window.partitionBy(*family).orderBy("t"))
    critical = flips.withColumn("r", r).where(F.col("r") == int(np.ceil(level * flip_count(n)))).select(*family, "t")
    g = x.groupBy(*family, *member, "structural").agg(F.avg(value).alias("m"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    g = g.withColumn("broken", F.bool_or(~F.col("structural") & ~(F.col("se") > 0)).over(Window.partitionBy(*family))).join(F.broadcast(critical), family, "left")
    half = F.when(F.col("structural"), 0.0).when(F.col("broken"), float("inf")).otherwise(F.col("t") * F.col("se"))
    mean = F.when(F.col("structural"), 0.0).otherwise(F.col("m"))
    return g.select(*family, *member, "structural", mean.alias("mean"), (mean - half).alias("lower"), (mean + half).alias("upper"))


STEPS = 200


def t_upper_tail(t: Column, df: Column) -> Column:
    """P[T > t] of Student's t: Simpson's rule over the substituted angle, divided by the same integral up to a right angle."""
    step = F.sequence(F.lit(0), F.lit(STEPS))

    def area(top: Column) -> Column:
        weight = lambda k: F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(step, F.lit(0.0), lambda s, k: s + weight(k) * F.pow(F.cos(top * k / STEPS), df - 1)) * top / (3 * STEPS)

    return 0.5 - 0.5 * area(F.atan(t / F.sqrt(df))) / area(F.lit(np.pi / 2))


def root_t(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """n, mean, t and the p of mean > 0; an error of zero or a single unit has p = 1."""
    g = df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    ok = (F.col("n") > 1) & (F.col("se") > 0)
    g = g.withColumn("t", F.when(ok, F.col("mean") / F.col("se")))
    return g.select(*key, "n", "mean", "t", F.coalesce(t_upper_tail(F.col("t"), F.col("n") - 1), F.lit(1.0)).alias("p"))


def _beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray, points: int = 128) -> np.ndarray:
    """Regularised incomplete beta for a, b >= 1, by Gauss' rule on x = sin(theta)**2.

    The log density in theta bends by (sqrt(2a - 1) + sqrt(2b - 1))**2 at least, so ten times the inverse root on both sides of the mode hold
    all but e**-50 of the mass, and the nodes lie as dense as the number of trials asks.
    """
    p, q = 2 * a - 1, 2 * b - 1
    mode, reach = np.arctan2(np.sqrt(p), np.sqrt(q)), 10 / (np.sqrt(p) + np.sqrt(q))
    lo, hi = np.maximum(mode - reach, 0), np.minimum(mode + reach, np.pi / 2)
    node, weight = np.polynomial.legendre.leggauss(points)
    log = lambda t: p[:, None] * np.log(np.sin(t)) + q[:, None] * np.log(np.cos(t))
    peak = log(mode[:, None])

    def area(end: np.ndarray) -> np.ndarray:
        half = (end - lo) / 2
        return np.exp(log(lo[:, None] + half[:, None] * (node + 1)) - peak) @ weight * half

    return area(np.clip(np.arcsin(np.sqrt(x)), lo, hi)) / area(hi)


def clopper_pearson(df: DataFrame, events: str, trials: str, alpha: float = 0.05) -> DataFrame:
    """Adds lower and upper, the exact binomial interval; each distinct (events, trials) is solved once. No trials: 0 to 1."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, n = b[events].to_numpy(float), b[trials].to_numpy(float)

            def root(a: np.ndarray, c: np.ndarray, p: float) -> np.ndarray:
                lo, hi = np.zeros(len(a)), np.ones(len(a))
                for _ in range(60):
                    mid = (lo + hi) / 2
                    under = _beta_cdf(a, c, mid) < p
                    lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
                return (lo + hi) / 2

            low = np.where(x > 0, root(np.maximum(x, 1), n - x + 1, alpha / 2), 0.0)
            high = np.where(x < n, root(x + 1, np.maximum(n - x, 1), 1 - alpha / 2), 1.0)
            yield pd.DataFrame({"_x": b[events], "_n": b[trials], "lower": low, "upper": high})

    pairs = df.where(F.col(events).isNotNull() & F.col(trials).isNotNull()).select(events, trials).distinct()
    solved = pairs.mapInPandas(solve, "_x long, _n long, lower double, upper double")
    return df.join(solved, (F.col(events) == F.col("_x")) & (F.col(trials) == F.col("_n")), "left").drop("_x", "_n")


def common_coverage(counts: DataFrame, family: list[str], rule: str, count: str, total: str, rules: int, share: float = 0.5) -> DataFrame:
    """The counts that all rules can attain; primary is the largest that covers at most ``share``."""
    g = counts.groupBy(*family, count).agg(F.count_distinct(rule).alias("_rules"), F.max(total).alias(total)).where(F.col("_rules") == rules).drop("_rules")
    g = g.withColumn("coverage", F.col(count) / F.col(total))
    best = F.max(F.when(F.col("coverage") <= share, F.col(count))).over(Window.partitionBy(*family))
    return g.withColumn("primary", F.coalesce(F.col(count) == best, F.lit(False)))


def paired_rule_bounds(first: DataFrame, second: DataFrame, intervals: DataFrame, pair: list[str]) -> DataFrame:
    """Bounds of risk(first) - risk(second), where each pair has one true sign for both rules among those that its interval allows.

    A pair without an interval, or with a null bound, may have any sign. A pair that one rule does not
    list counts as held there. Risks are shares of each rule's own publications; a rule that publishes
    nothing adds no risk.
    """
    x = first.select(*pair, F.col("direction").alias("d1")).join(second.select(*pair, F.col("direction").alias("d2")), pair, "full")
    x = x.withColumn("d1", F.coalesce("d1", F.lit("hold"))).withColumn("d2", F.coalesce("d2", F.lit("hold"))).join(intervals.select(*pair, "lower", "upper"), pair, "left")
    published = lambda d: F.count_if(F.col(d) != "hold")
    n = F.broadcast(x.agg(published("d1").alias("n1"), published("d2").alias("n2")))  # one row
    lo, hi = F.coalesce("lower", F.lit(float("-inf"))), F.coalesce("upper", F.lit(float("inf")))
    signs = F.array_compact(F.array(F.when(lo < 0, -1), F.when((lo <= 0) & (hi >= 0), 0), F.when(hi > 0, 1)))
    wrong = lambda d, k: F.when(((F.col(d) == "a") & (F.col("sign") < 0)) | ((F.col(d) == "b") & (F.col("sign") > 0)), 1.0 / F.col(k)).otherwise(0.0)
    e = x.crossJoin(n).withColumn("sign", F.explode(signs)).withColumn("diff", wrong("d1", "n1") - wrong("d2", "n2"))
    per = e.groupBy(*pair).agg(F.min("diff").alias("lo"), F.max("diff").alias("hi"))
    return per.agg(F.sum("lo").alias("lower"), F.sum("hi").alias("upper"), F.count("*").alias("n"))


def topk_change(first: DataFrame, second: DataFrame, key: list[str], item: str, value: str, k: int, threshold: float) -> DataFrame:
    """Do the k largest items differ; eligible where in both tables the k-th and the next are more than ``threshold`` apart."""

    def top(df: DataFrame, n: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(value), item))
        x = df.withColumn("_r", r).where(F.col("_r") <= k + 1)
        at = lambda i: F.max(F.when(F.col("_r") == i, F.col(value)))
        return x.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("_r") <= k, F.col(item)))).alias(f"top{n}"), (at(k) - at(k + 1)).alias(f"gap{n}"))

    j = top(first, "1").join(top(second, "2"), key)
    return j.select(*key, (F.col("top1") != F.col("top2")).alias("changed"), F.coalesce((F.col("gap1") > threshold) & (F.col("gap2") > threshold), F.lit(False)).alias("eligible"))


def recompute_check(df: DataFrame, key: list[str], columns: list[str], fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Re-derive ``columns`` with the user's ``fn`` over Arrow batches and demand exact equality: one row of counts per column. ``key`` must be unique."""
    types = dict(df.dtypes)
    again = df.mapInPandas(fn, ", ".join(f"`{c}` {types[c]}" for c in [*key, *columns]))
    a, b = df.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns]), again.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_found"))
    j = a.join(b, key, "left")
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col("_found").isNull()).alias("missing"), F.count_if(F.col("_found").isNotNull() & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias("different")) for c in columns]
    return j.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
