"""Averages up a hierarchy, pairwise margins, reversals, ranks and selections. Chained means are never merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contraspark.operators.prefix import running
from contraspark.sources.storage import keep


def chained_mean(df: DataFrame, levels: list[str], keep: list[str], value: str) -> DataFrame:
    """Mean over the first level, then of these means over the next, and so on; ``keep`` stays."""
    for i in range(len(levels)):
        df = df.groupBy(*levels[i + 1 :], *keep).agg(F.avg(value).alias(value))
    return df


def margins(df: DataFrame, key: list[str], item: str, value: str) -> DataFrame:
    """key, model_a, model_b, margin = value of b minus value of a, for a < b."""
    a, b = df.alias("a"), df.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key] + [F.col(f"a.{item}") < F.col(f"b.{item}")]
    return a.join(b, on).select(*[f"a.{c}" for c in key], F.col(f"a.{item}").alias("model_a"), F.col(f"b.{item}").alias("model_b"), (F.col(f"b.{value}") - F.col(f"a.{value}")).alias("margin"))


def midrank(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Average ranks with exact ties, the largest value first."""
    rank = F.rank().over(Window.partitionBy(*key).orderBy(F.desc(value)))
    return df.withColumn("midrank", rank + (F.count("*").over(Window.partitionBy(*key, value)) - 1) / 2.0)


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """Label of the move between two margins: tie_both, tie_transition, reversal or stable_order."""
    s, t = F.signum(before), F.signum(after)
    label = F.when((s == 0) & (t == 0), "tie_both").when((s == 0) | (t == 0), "tie_transition").when(s != t, "reversal").otherwise("stable_order")
    return df.withColumn("transition", label)


def against_base(df: DataFrame, key: list[str], axis: str, base: str, value: str) -> DataFrame:
    """Rows of the other values of ``axis`` with the value at ``base`` as before and their own as after."""
    b = df.where(F.col(axis) == base).select(*key, F.col(value).alias("before"))
    return df.where(F.col(axis) != base).join(b, key).withColumnRenamed(value, "after")


def strict_crossing(df: DataFrame, tau: float = 1e-12) -> DataFrame:
    crossed = (F.signum("before") != F.signum("after")) & (F.abs("before") > tau) & (F.abs("after") > tau)
    return df.withColumn("crossed", crossed)


def leave_one_out(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mean over the other rows of the key; null for a single row."""
    w = Window.partitionBy(*key)
    n = F.count(value).over(w)
    return df.withColumn("others_mean", F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1)))


def inversions(df: DataFrame, key: list[str], place: str, rank: str, bits: int) -> DataFrame:
    """key, inversions: pairs of rows with a smaller ``place`` and a larger ``rank`` (an integer from 0, below 2**bits).

    Two ranks differ first at one bit: there the larger has a one. So the rows are taken once for each bit,
    grouped by the higher bits, and each zero counts the ones placed before it; n rows cost n * bits rows of
    running sums, and no pairs are made.
    """
    each = df.select(*key, place, rank, F.explode(F.sequence(F.lit(0), F.lit(max(0, bits - 1)))).alias("_bit"))
    each = each.select(*key, place, "_bit", F.expr(f"shiftright({rank}, _bit + 1)").alias("_high"), F.expr(f"shiftright({rank}, _bit) & 1").alias("_one"))
    counted = running(each, [*key, "_bit", "_high"], [place], {"_ones": F.col("_one")}, rank="_k")
    return counted.groupBy(*key).agg(F.sum(F.when(F.col("_one") == 0, F.col("_ones")).otherwise(0)).alias("inversions"))


def metric_concordance(df: DataFrame, key: list[str], item: str, x: str, y: str) -> DataFrame:
    """Agreement of two losses of the same items: tau_b, and whether midranks and the sets of leaders are identical.

    tau_b counts discordant pairs by ``inversions``. It is null where a loss is constant over the items
    (status constant_metric) or a value is missing or not finite (missing_score; then nothing is compared).
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    gaps = df.groupBy(*key).agg(F.count("*").alias("items"), F.count_if(~(fine(x) & fine(y))).alias("_gaps"))
    rows = df.select(*key, item, (F.col(x) + 0.0).alias("_x"), (F.col(y) + 0.0).alias("_y"))
    return _concordance(rows, gaps, key, item)


def _on(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with the other columns of ``other`` for its key; null keys meet."""
    own = other.select(*[F.col(c).alias(f"_j_{c}") for c in key], *[c for c in other.columns if c not in key])
    return df.join(own, reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in key])).drop(*[f"_j_{c}" for c in key])


def _concordance(rows: DataFrame, gaps: DataFrame, key: list[str], item: str) -> DataFrame:
    rows = keep(_on(rows, gaps.where("_gaps = 0"), key).drop("items", "_gaps"), "concordance")
    # Midranks: rows of smaller values, and half of the ties; the least of a tie stands for its dense place.
    for c in ("_x", "_y"):
        placed = running(rows, key, [c], rank=f"{c}k")
        ties = placed.groupBy(*key, c).agg(F.min(f"{c}k").alias(f"{c}r"), F.count("*").alias(f"{c}n"))
        rows = _on(placed.drop(f"{c}k"), ties, [*key, c])
    rows = keep(running(rows, key, ["_x", "_y"], rank="_place").withColumn("_rank", (F.col("_yr") - 1).cast("long")), "concordance")
    bits = int(rows.agg(F.max("_rank")).first()[0] or 0).bit_length()
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    both = rows.groupBy(*key, "_x", "_y").agg(F.count("*").alias("_n")).groupBy(*key).agg(F.sum(pairs("_n")).alias("_txy"))
    g = rows.groupBy(*key).agg(
        F.count("*").alias("_all"), F.sum((F.col("_xn") - 1) / 2).alias("_tx"), F.sum((F.col("_yn") - 1) / 2).alias("_ty"),
        F.bool_and((F.col("_xr") == F.col("_yr")) & (F.col("_xn") == F.col("_yn"))).alias("ranks_identical"), F.bool_and((F.col("_xr") == 1) == (F.col("_yr") == 1)).alias("leader_sets_identical"),
    )
    g = _on(_on(g, both, key), inversions(rows, key, "_place", "_rank", max(1, bits)), key)
    total = pairs("_all")
    free_x, free_y = total - F.col("_tx"), total - F.col("_ty")
    concordant = total - F.col("_tx") - F.col("_ty") + F.col("_txy") - F.col("inversions")
    tau = F.when((free_x > 0) & (free_y > 0), (concordant - F.col("inversions")) / F.sqrt(free_x * free_y))
    out = g.select(*key, tau.alias("tau_b"), "ranks_identical", "leader_sets_identical", F.when(tau.isNull(), "constant_metric").otherwise("defined").alias("status"))
    none = F.lit(None)
    lacking = gaps.where("_gaps > 0").select(*key, none.cast("double").alias("tau_b"), none.cast("boolean").alias("ranks_identical"), none.cast("boolean").alias("leader_sets_identical"), F.lit("missing_score").alias("status"))
    return out.union(lacking)


def winners(df: DataFrame, key: list[str], item: str, loss: str, order: list[str] | None = None, tau: float = 1e-12) -> DataFrame:
    """Best item of each key, of those within tau the first in ``order`` (by name without one; undeclared items last), how many tie, the gap of
    the second to the first, and the gap to the best outside the tie (null where there is none)."""
    w = Window.partitionBy(*key)  # the items of one key
    place = F.lit(0) if order is None else F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(item)), F.lit(0)), F.lit(len(order) + 1))
    best = df.withColumn("_gap", F.col(loss) - F.min(loss).over(w)).withColumn("_place", place)
    best = best.withColumn("_nth", F.row_number().over(w.orderBy("_gap", "_place", item)))
    g = best.groupBy(*key)
    first = F.min(F.when(F.col("_gap") <= tau, F.struct("_place", F.col(item).alias("item"))))
    return g.agg(
        first["item"].alias("winner"), F.count_if(F.col("_gap") <= tau).alias("tied"), F.min(F.when(F.col("_nth") == 2, F.col("_gap"))).alias("second_gap"), F.min(F.when(F.col("_gap") > tau, F.col("_gap"))).alias("outside_gap"),
    )


def winner_stability(df: DataFrame, key: list[str], root: str, item: str, loss: str, order: list[str] | None = None, tau: float = 1e-12) -> DataFrame:
    """``winners`` of the mean over all roots (held_out null) and over all but each root, from sums and counts.

    same: whether the winner is that of all roots; stability: the share of roots that can be left out
    without a change. A key with one root has no held-out rows. Roots that are null are not held out.
    """
    per = df.groupBy(*key, root, item).agg(F.avg(loss).alias("_v"))
    total = per.groupBy(*key, item).agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    alone = per.select(*key, item, F.col(root).alias("held_out"), "_v").where(F.col("held_out").isNotNull())
    less = _on(alone, total, [*key, item]).where("_n > 1").select(*key, item, "held_out", ((F.col("_s") - F.col("_v")) / (F.col("_n") - 1)).alias("_m"))
    whole = total.select(*key, item, F.lit(None).cast(df.schema[root].dataType).alias("held_out"), (F.col("_s") / F.col("_n")).alias("_m"))
    won = winners(less.union(whole), [*key, "held_out"], item, "_m", order, tau)
    top = won.where(F.col("held_out").isNull()).select(*key, F.col("winner").alias("_top"))
    out = _on(won, top, key).withColumn("same", F.col("winner") == F.col("_top")).drop("_top")
    share = out.where(F.col("held_out").isNotNull()).groupBy(*key).agg(F.avg(F.col("same").cast("double")).alias("stability"))
    own = share.select(*[F.col(c).alias(f"_j_{c}") for c in key], "stability")
    return out.join(own, reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in key]), "left").drop(*[f"_j_{c}" for c in key])


def weighted_summary(df: DataFrame, key: list[str], rule: str, base: str, value: str, weight: str) -> DataFrame:
    """Weighted mean of each rule and its relative reduction against the base rule (null where that is 0)."""
    m = df.groupBy(*key, rule).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
    b = m.where(F.col(rule) == base).select(*key, F.col("mean").alias("base"))
    return m.join(b, key).select(*key, rule, "mean", F.when(F.col("base") != 0, 1 - F.col("mean") / F.col("base")).alias("reduction"))


def fixed_argmin(losses: DataFrame, key: list[str], item: str, loss: str, tau: float = 1e-12, order: list[str] | None = None) -> DataFrame:
    """Per key the item of least loss with its loss; of items within ``tau`` the first in ``order`` (by name without one), in column ``family``."""
    best = losses.groupBy(*key).agg(F.min(loss).alias("_best"))
    near = losses.join(best, key).where(F.col(loss) <= F.col("_best") + tau)
    place = F.col(item) if order is None else F.array_position(F.array(*[F.lit(x) for x in order]), F.col(item))
    first = near.groupBy(*key).agg(F.min(F.struct(place.alias("place"), F.col(item).alias("family"), F.col(loss).alias("loss"))).alias("x"))
    return first.select(*key, "x.family", F.col("x.loss").alias(loss))
