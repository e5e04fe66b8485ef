"""Calibrate, decide, check: when may a comparison be released, and how often is a release wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contraspark.operators.comparison import margins
from contraspark.operators.prefix import running

PAIR = ["budget", "model_a", "model_b"]


def oriented(scores: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """Margins of all pairs in each case, unit, budget and realization; positive where model_a is better."""
    m = margins(scores, ["case_id", "unit", "budget", "realization"], "model", "score")
    return m if lower_is_better else m.withColumn("margin", -F.col("margin"))


def shifts(scores: DataFrame, anchor: str = "1", lower_is_better: bool = True) -> DataFrame:
    """Per case and pair: the anchor margin and the largest move of another realization away from it."""
    m = oriented(scores, lower_is_better)
    at = F.max(F.when(F.col("realization") == anchor, F.col("margin")))
    g = m.groupBy("case_id", "unit", *PAIR).agg(at.alias("anchor"), F.max("margin").alias("top"), F.min("margin").alias("bottom")).where("anchor is not null")
    return g.select("case_id", "unit", *PAIR, "anchor", F.greatest(F.col("top") - F.col("anchor"), F.col("anchor") - F.col("bottom")).alias("shift"))


def calibrate_shift(development: DataFrame, lower_is_better: bool = True) -> DataFrame:
    return shifts(development, lower_is_better=lower_is_better).groupBy(*PAIR).agg(F.max("shift").alias("bound"))


def calibrate_geometry(development: DataFrame, geometry: DataFrame, tolerance: float = 1e-12, tau: float = 1e-12, lower_is_better: bool = True) -> DataFrame:
    """Largest shift over geometry, with the reason where it is not available.

    A case without geometry that shifts makes it unavailable; so does the lack of any case with positive
    geometry, or a development case whose geometry is not given at all.
    """
    j = shifts(development, lower_is_better=lower_is_better).join(geometry.select("case_id", "budget", "geometry"), ["case_id", "budget"], "left")
    zero, lacking = F.col("geometry") <= tolerance, F.col("geometry").isNull()
    g = j.groupBy(*PAIR).agg(
        F.max(F.when(~zero, F.col("shift") / F.col("geometry"))).alias("factor"), F.count_if(zero & (F.col("shift") > tau)).alias("unexplained"), F.count_if(lacking).alias("lacking"),
    )
    reason = (
        F.when(F.col("lacking") > 0, "geometry_not_supplied").when(F.col("unexplained") > 0, "development_zero_geometry_shift")
        .when(F.col("factor").isNull(), "no_positive_development_geometry").otherwise("available")
    )
    return g.withColumn("reason", reason).withColumn("factor", F.when(F.col("reason") == "available", F.col("factor"))).drop("lacking")


def release_decisions(
    anchors: DataFrame, shift: DataFrame, geometry_factor: DataFrame, geometry: DataFrame, gap: float, tau: float = 1e-12, tolerance: float = 1e-12, lower_is_better: bool = True,
) -> DataFrame:
    """Each anchor margin under three policies: released iff |margin| > limit + gap + tau, held with a reason otherwise.

    Every anchor margin has a row for each policy: one without a bound, factor or geometry is held, and
    the geometry-scaled limit is not available where the case's geometry is at or below ``tolerance``.
    """
    m = oriented(anchors, lower_is_better).join(shift, PAIR, "left").join(geometry_factor.select(*PAIR, "factor", F.col("reason").alias("why")), PAIR, "left")
    m = m.join(geometry.select("case_id", "budget", "geometry"), ["case_id", "budget"], "left")
    lacking = (
        F.when(F.col("why") != "available", F.col("why")).when(F.col("factor").isNull() | F.col("geometry").isNull(), "geometry_not_supplied")
        .when(F.col("geometry") <= tolerance, "assessment_geometry_at_or_below_tolerance")
    )
    policy = lambda name, bound, held: F.struct(F.lit(name).alias("policy"), F.when(held.isNull(), bound).alias("limit"), held.alias("held"))
    no_bound = F.when(F.col("bound").isNull(), "no_development_bound")
    policies = F.array(
        policy("single_split", F.lit(0.0), F.lit(None).cast("string")), policy("repeated_primary", F.col("bound"), no_bound), policy("geometry_scaled", F.col("factor") * F.col("geometry"), lacking),
    )
    d = m.select("case_id", "unit", *PAIR, "margin", F.explode(policies).alias("p")).select("case_id", "unit", *PAIR, "margin", "p.*")
    released = F.coalesce(F.abs("margin") > F.col("limit") + gap + tau, F.lit(False))
    reason = F.coalesce("held", F.when(F.col("released"), "margin_exceeds_range_and_gap").otherwise("margin_within_range_or_gap"))
    favoured = F.when(F.col("margin") > tau, F.col("model_a")).when(F.col("margin") < -tau, F.col("model_b"))
    return d.withColumn("released", released).withColumn("reason", reason).withColumn("favoured", favoured).drop("held")


def assess(decisions: DataFrame, assessment: DataFrame, gap: float, tau: float = 1e-12) -> DataFrame:
    """Decisions with the anchor-oriented margins of all realizations: supported, strict reversal, tie, within gap.

    A decision without assessment margins, or with a null one, stays, with realizations as counted and no flags.
    """
    a = oriented(assessment).select("case_id", *PAIR, F.col("margin").alias("m"), F.lit(1).alias("_here"))
    j = decisions.join(a, ["case_id", *PAIR], "left")
    o = F.signum("margin") * F.col("m")
    key = ["case_id", "unit", *PAIR, "policy", "margin", "limit", "released", "favoured"]
    whole = (F.count("_here") > 0) & (F.count("_here") == F.count("m"))
    flag = lambda c: F.when(whole, c)
    return j.groupBy(*key).agg(
        F.count("_here").alias("realizations"), flag(F.bool_and(o > gap + tau)).alias("supported"), flag(F.bool_or(o < -tau)).alias("reversal"), flag(F.bool_or(F.abs(o) <= tau)).alias("tie"),
        flag(F.bool_or((o > tau) & (o <= gap + tau))).alias("within_gap"),
    )


def policy_summary(assessed: DataFrame) -> DataFrame:
    """Counts and shares of each budget and policy; a release that could not be assessed is not supported."""
    r = F.col("released")
    g = assessed.groupBy("budget", "policy").agg(F.count("*").alias("comparisons"), F.count_if(r).alias("n_released"), F.count_if(r & ~F.coalesce("supported", F.lit(False))).alias("unsupported"), F.count_if(r & F.col("reversal")).alias("reversals"))
    return g.withColumn("coverage", F.col("n_released") / F.col("comparisons")).withColumn("unsupported_share", F.when(F.col("n_released") > 0, F.col("unsupported") / F.col("n_released")))


def compare_policies(summary: DataFrame, policy: str = "geometry_scaled", base: str = "repeated_primary") -> DataFrame:
    """budget, verdict: is a policy better than another, by unsupported releases (no more) and coverage (no less).

    strict_gain: better in one of them; parity: equal in both; no_gain otherwise; insufficient_releases: the policy releases nothing.
    """
    of = lambda p, c: F.max(F.when(F.col("policy") == p, F.col(c)))
    g = summary.groupBy("budget").agg(of(policy, "n_released").alias("n"), *[of(p, c).alias(f"{c}_{i}") for i, p in enumerate((policy, base)) for c in ("unsupported", "coverage")])
    fewer, more = F.col("unsupported_0") < F.col("unsupported_1"), F.col("coverage_0") > F.col("coverage_1")
    fine = (F.col("unsupported_0") <= F.col("unsupported_1")) & (F.col("coverage_0") >= F.col("coverage_1"))
    return g.select("budget", F.when(F.col("n") == 0, "insufficient_releases").when(fine & (fewer | more), "strict_gain").when(fine, "parity").otherwise("no_gain").alias("verdict"))


def budget_recommendation(decisions: DataFrame, models: int, order: list[str]) -> DataFrame:
    """Per case and policy: the first budget where one model is released as favoured against all others; held (nulls) without one."""
    won = decisions.where("released").groupBy("case_id", "policy", "budget", "favoured").agg(F.count("*").alias("wins")).where(F.col("wins") == models - 1)
    place = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("budget"))
    first = won.groupBy("case_id", "policy").agg(F.min(F.struct(place.alias("p"), "budget", "favoured")).alias("x")).select("case_id", "policy", "x.budget", F.col("x.favoured").alias("winner"))
    return decisions.select("case_id", "policy").distinct().join(first, ["case_id", "policy"], "left")


def risk_coverage(rows: DataFrame, key: list[str], priority: str, bad: str, ties: list[str], strict: str | None = None) -> DataFrame:
    """For each prefix by falling priority: rank, coverage, risk, with ``strict`` also the share of strictly wrong rows, and how many rows share the cut-off priority."""
    count = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    sums = {"_bad": count(bad)} | ({"_strict": count(strict)} if strict else {})
    out = running(rows, key, [F.desc(priority), *ties], sums, total="_n")
    share = rows.groupBy(*key, F.col(priority).alias("_p")).agg(F.count("*").alias("tied")).select(*[F.col(c).alias(f"_k_{c}") for c in key], "_p", "tied")
    out = out.join(share, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key] + [F.col(priority).eqNullSafe(F.col("_p"))])
    risks = {"risk": F.col("_bad") / F.col("k")} | ({"strict_risk": F.col("_strict") / F.col("k")} if strict else {})
    return out.select(*rows.columns, "k", (F.col("k") / F.col("_n")).alias("coverage"), *[c.alias(name) for name, c in risks.items()], "tied")


def unit_macro_curve(rows: DataFrame, key: list[str], unit: str, priority: str, bad: str, ties: list[str]) -> DataFrame:
    """For each prefix the mean over its units of the unit's error share, and the mean over all units of the unit's covered share.

    Both are running sums of the changes that a row makes to its unit's shares.
    """
    order = [F.desc(priority), *ties]
    wrong = F.coalesce(F.col(bad), F.lit(False)).cast("long")
    own = running(rows, [*key, unit], order, {"_e": wrong}, rank="_r", total="_t")
    was = F.when(F.col("_r") == 1, 0.0).otherwise((F.col("_e") - wrong) / (F.col("_r") - 1))
    own = own.withColumn("_move", F.col("_e") / F.col("_r") - was)
    out = running(own, key, order, {"_risk": F.col("_move"), "units": F.when(F.col("_r") == 1, 1).otherwise(0), "_cov": 1 / F.col("_t")})
    every = rows.groupBy(*key).agg(F.count_distinct(unit).alias("_units")).select(*[F.col(c).alias(f"_k_{c}") for c in key], "_units")
    out = out.join(every, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key])
    return out.select(*rows.columns, "k", "units", (F.col("_risk") / F.col("units")).alias("macro_risk"), (F.col("_cov") / F.col("_units")).alias("macro_coverage"))
