"""Which directions may be reported: five rules over one panel of margins, and rank sets from simultaneous intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraspark.operators.inference import closure, schedule

#: The rules in their order.
RULES = ("score_margin", "repeated_splitting", "cross_fitting", "unit_resampling", "calibrated_margin")
COMPANION = "cross_fitting_first_partition"
TAU, QUANTILE = 1e-12, 0.05


def calibration_penalty(margins: DataFrame, pair: list[str], unit: str, allocation: str, anchor, margin: str) -> DataFrame:
    """Largest move of a margin away from its anchor allocation, over all units given and allocations; null where an anchor or a margin is missing."""
    at = F.max(F.when(F.col(allocation) == anchor, F.col(margin)))
    per = margins.groupBy(*pair, unit).agg(at.alias("_a"), F.max(margin).alias("_hi"), F.min(margin).alias("_lo"), F.bool_or(F.col(margin).isNull()).alias("_gap"))
    move = F.greatest(F.col("_hi") - F.col("_a"), F.col("_a") - F.col("_lo"))
    return per.groupBy(*pair).agg(F.when(~F.bool_or(F.col("_gap") | F.col("_a").isNull()), F.max(move)).alias("penalty"))


def publication_candidates(margins: DataFrame, penalty: DataFrame, pair: list[str], unit: str, allocation: str, margin: str, reps: int = 200, seed: str = "p1") -> DataFrame:
    """rule, pair, estimate, direction, score, eligible, reason: every rule for every pair, and the companion of cross-fitting.

    ``margins`` has a row for each unit, allocation and pair, positive where the first of the pair is better.
    Allocations are numbered from 0; 2j and 2j + 1 are complementary folds, each scored on its own held-out
    controls, and 0 is the anchor. Estimates are means over units of the anchor (score_margin,
    calibrated_margin) or of all allocations. Scores: the estimate's size (score_margin, cross_fitting); the
    5 % element of the oriented means of single allocations (repeated_splitting) or of resampled unit means
    (unit_resampling; one schedule of draws for all pairs); the size minus the pair's ``penalty``.

    A pair without a margin for every unit and allocation, or with a margin that is not finite, has no estimate
    (reason incomplete_panel); one without a penalty has no calibrated score (no_calibration). An odd number
    of allocations, or one that is not 0, 1, ... in order, makes every pair incomplete. So do fewer than two units.
    """
    roster = margins.select(unit).distinct()
    a = F.col(allocation)
    # One row: what a complete pair must have.
    shape = margins.agg(F.count_distinct(unit).alias("n_units"), F.count_distinct(allocation).alias("n_alloc"), F.min(allocation).alias("_lo"), F.max(allocation).alias("_hi"))
    even = (F.col("n_alloc") % 2 == 0) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("n_alloc") - 1) & (F.col("n_units") >= 2)
    shape = F.broadcast(shape.select("n_units", "n_alloc", F.coalesce(even, F.lit(False)).alias("_even")))
    bad = F.col(margin).isNull() | F.isnan(margin) | (F.abs(margin) == float("inf"))
    per_unit = margins.groupBy(*pair, unit).agg(F.count("*").alias("n"), F.count_distinct(allocation).alias("na"), F.count_if(bad).alias("bad"), F.avg(margin).alias("mean"), F.avg(F.when(a == 0, F.col(margin))).alias("at0"), F.avg(F.when(a < 2, F.col(margin))).alias("first"))
    wanted = (F.col("units") == F.col("n_units")) & (F.col("rows") == F.col("n_units") * F.col("n_alloc")) & (F.col("least") == F.col("n_alloc")) & (F.col("bad") == 0) & F.col("_even")
    whole = per_unit.groupBy(*pair).agg(F.count("*").alias("units"), F.sum("n").alias("rows"), F.min("na").alias("least"), F.sum("bad").alias("bad"), F.avg("mean").alias("mean"), F.avg("at0").alias("at0"), F.avg("first").alias("first"))
    whole = whole.crossJoin(shape).withColumn("_ok", wanted)
    value = lambda c: F.when(F.col("_ok"), F.col(c)).alias(c)
    whole = whole.select(*pair, value("mean"), value("at0"), value("first"), (F.floor((F.col("n_alloc") - 1) * F.lit(QUANTILE)) + 1).alias("nth"))
    sign = lambda c: F.when(F.col(c) > TAU, 1).when(F.col(c) < -TAU, -1).when(F.col(c).isNotNull(), 0)
    whole = whole.withColumn("d", sign("mean"))

    # The 5 % elements: a rank among a pair's allocations, and among its draws.
    def element(values: DataFrame, by: str, nth: Column | int, name: str) -> DataFrame:
        j = values.join(whole.select(*pair, "d", "nth"), pair).withColumn("_x", F.col("d") * F.col("_v"))
        r = F.row_number().over(Window.partitionBy(*pair).orderBy("_x", by))
        return j.withColumn("_r", r).where(F.col("_r") == nth).select(*pair, F.col("_x").alias(name))

    pooled = margins.groupBy(*pair, a.alias("_by")).agg(F.avg(margin).alias("_v"))
    times = schedule(roster, unit, reps, seed)
    drawn = per_unit.select(*pair, unit, "mean").join(times, unit).groupBy(*pair, F.col("rep").alias("_by")).agg((F.sum(F.col("mean") * F.col("times")) / F.sum("times")).alias("_v"))
    g = whole.join(element(pooled, "_by", F.col("nth"), "split"), pair, "left").join(element(drawn, "_by", math.floor((reps - 1) * QUANTILE) + 1, "boot"), pair, "left")
    g = g.join(penalty.select(*pair, "penalty"), pair, "left")
    size = {"score_margin": F.abs("at0"), "repeated_splitting": F.col("split"), "cross_fitting": F.abs("mean"), "unit_resampling": F.col("boot"), "calibrated_margin": F.abs("at0") - F.col("penalty"), COMPANION: F.abs("first")}
    estimate = {rule: F.col("at0" if rule in ("score_margin", "calibrated_margin") else "first" if rule == COMPANION else "mean") for rule in (*RULES, COMPANION)}
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), estimate[rule].alias("estimate"), F.when(estimate[rule].isNotNull(), size[rule]).alias("score")) for rule in (*RULES, COMPANION)])
    out = g.select(*pair, F.explode(rows).alias("x")).select("x.rule", *pair, "x.estimate", "x.score")
    d = sign("estimate")
    floor = F.when(F.col("rule") == COMPANION, F.lit(True)).otherwise(F.col("score") > TAU)
    reason = F.when(F.col("estimate").isNull(), "incomplete_panel").when(d == 0, "direction_tie").when(F.col("score").isNull(), "no_calibration").when(floor, "eligible").otherwise("score_below_floor")
    direction = F.when(d == 1, "a").when(d == -1, "b").when(d == 0, "hold")
    return out.select("rule", *pair, "estimate", direction.alias("direction"), "score", (reason == "eligible").alias("eligible"), reason.alias("reason"))


def decision_sets(intervals: DataFrame, methods: DataFrame, key: list[str]) -> DataFrame:
    """in_best_set, rank_lower and rank_upper of each method from simultaneous intervals (model_a, model_b, lower, upper).

    A positive lower bound puts a above b, a negative upper one b above a; the relation is closed under
    chains. Nothing stands above a method of the best set; its rank lies between one more than the methods
    above it and those not below it. A cycle in a family leaves every method in the best set, with ranks 1
    to the number of methods. Intervals that are null or infinite decide nothing. ``methods`` (key, method)
    is the roster, so methods without intervals are ranked too.
    """
    up = intervals.where("lower > 0").select(*key, F.col("model_a").alias("source"), F.col("model_b").alias("target"))
    down = intervals.where("upper < 0").select(*key, F.col("model_b").alias("source"), F.col("model_a").alias("target"))
    reach = closure(up.union(down), key)
    row = lambda df, method, what: df.select(*key, F.col(method).alias("method"), F.lit(what).alias("what"), (F.col("source") == F.col("target")).alias("loop"))
    roster = methods.select(*key, "method").distinct().select(*key, "method", F.lit("roster").alias("what"), F.lit(False).alias("loop"))
    parts = roster.union(row(reach, "source", "below")).union(row(reach, "target", "above"))
    of = lambda what: F.count_if(F.col("what") == what).alias(what)
    g = parts.groupBy(*key, "method").agg(of("above"), of("below"), F.bool_or("loop").alias("loop"))
    family = Window.partitionBy(*key)  # one row for each method
    n, cyclic = F.count("*").over(family), F.bool_or("loop").over(family)
    g = g.withColumn("methods", n).withColumn("cyclic", cyclic)
    return g.select(
        *key, "method", (F.col("cyclic") | (F.col("above") == 0)).alias("in_best_set"), F.when(F.col("cyclic"), F.lit(1).cast("long")).otherwise(F.col("above") + 1).alias("rank_lower"),
        F.when(F.col("cyclic"), F.col("methods")).otherwise(F.col("methods") - F.col("below")).alias("rank_upper"), F.when(F.col("cyclic"), "cycle").otherwise("ranked").alias("status"),
    )
