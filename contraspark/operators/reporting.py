"""Reporting rules, directions and bounds; program scores and baselines; matching tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contraspark.operators.prefix import running


def tie_blocks(df: DataFrame, key: list[str], score: str, order: list[str], tau: float) -> DataFrame:
    """Rows by falling score; a gap of at most tau to the one before chains a row into its block. count: rows up to the block's end."""
    by = [F.desc(score), *order]
    linked = running(df, key, by, before={"_above": F.col(score)}, rank="_k")
    b = running(linked.withColumn("_new", F.when(F.col("_above") - F.col(score) <= tau, 0).otherwise(1)), key, by, sums={"block": F.col("_new")}, rank="_k")
    return b.groupBy(*key, "block").agg(F.count("*").alias("rows"), F.max(score).alias("top"), F.min(score).alias("bottom"), F.max("_k").alias("count"))


def classify_directions(directions: DataFrame, intervals: DataFrame, pair: list[str]) -> DataFrame:
    """supported, reversed, unresolved or hold of each reported direction (a, b or hold). One without an interval is unresolved."""
    j = directions.join(intervals, pair, "left")
    lo = F.when(F.col("direction") == "a", F.col("lower")).otherwise(-F.col("upper"))
    hi = F.when(F.col("direction") == "a", F.col("upper")).otherwise(-F.col("lower"))
    return j.withColumn("outcome", F.when(F.col("direction") == "hold", "hold").when(lo > 0, "supported").when(hi < 0, "reversed").otherwise("unresolved"))


def reversal_bounds(directions: DataFrame, intervals: DataFrame, pair: list[str], by: list[str]) -> DataFrame:
    """Least and most possible number of reversals, given the signs that each interval allows; one without an interval allows all."""
    j = directions.join(intervals, pair, "left").withColumn("lower", F.coalesce("lower", F.lit(float("-inf")))).withColumn("upper", F.coalesce("upper", F.lit(float("inf"))))
    against = F.when(F.col("direction") == "a", F.col("lower") < 0).when(F.col("direction") == "b", F.col("upper") > 0).otherwise(False)
    sure = F.when(F.col("direction") == "a", F.col("upper") < 0).when(F.col("direction") == "b", F.col("lower") > 0).otherwise(False)
    return j.groupBy(*by).agg(F.count_if(sure).alias("least"), F.count_if(against).alias("most"), F.count("*").alias("n"))


def program_scores(effects: DataFrame, programs: DataFrame, scales: DataFrame, least_members: int, least_share: float) -> DataFrame:
    """Mean standardized effect over a program's covered genes, where enough of them are covered."""
    size = programs.groupBy("program_id").agg(F.count("*").alias("members"))
    j = effects.join(scales, "gene").join(F.broadcast(programs), "gene").groupBy("task", "program_id").agg(F.avg(F.col("value") / F.col("scale")).alias("score"), F.count("*").alias("covered"))
    return j.join(F.broadcast(size), "program_id").where((F.col("covered") >= least_members) & (F.col("covered") >= least_share * F.col("members"))).select("task", "program_id", "score", "covered")


def top_genes(effects: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k genes of largest absolute effect, zeros left out, the smaller gene of equals."""
    w = Window.partitionBy(*key).orderBy(F.desc(F.abs("value")), "gene")
    return effects.where("value <> 0").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def topk_overlap(a: DataFrame, b: DataFrame, key: list[str], k: int) -> DataFrame:
    """Jaccard overlap of the top genes of two effects and the share of common ones with one sign."""
    x, y = top_genes(a, key, k).select(*key, "gene", F.col("value").alias("va")), top_genes(b, key, k).select(*key, "gene", F.col("value").alias("vb"))
    j = x.join(y, [*key, "gene"], "full").groupBy(*key).agg(F.count("*").alias("either"), F.count_if(F.col("va").isNotNull() & F.col("vb").isNotNull()).alias("both"), F.count_if(F.signum("va") == F.signum("vb")).alias("same"))
    return j.select(*key, (F.col("both") / F.col("either")).alias("jaccard"), F.when(F.col("both") > 0, F.col("same") / F.col("both")).alias("same_sign"))


#: Integers and their exact sums and products.
_WIDE = "decimal(38,0)"


def matching_means(members: DataFrame, matching: list[str], item: str, numerator: str, denominator: str) -> DataFrame:
    """Sums of fractions with one denominator in each matching, compared exactly: numerator, denominator, rank and leads of each item.

    All fractions of a matching must share ``denominator`` (else an error), so sums and comparisons are those of
    integers. rank is one more than the items with larger sums; equal sums share it.
    """
    n, d = F.col(numerator).cast(_WIDE), F.col(denominator).cast(_WIDE)
    g = members.groupBy(*matching, item).agg(F.sum(n).cast(_WIDE).alias("numerator"), F.min(d).alias("denominator"), F.max(d).alias("_d"))
    one = F.min("denominator").over(Window.partitionBy(*matching)) == F.max("_d").over(Window.partitionBy(*matching))  # the items of one matching
    checked = F.when(one, F.col("numerator")).otherwise(F.raise_error(F.lit("the fractions of a matching have several denominators")).cast(_WIDE))
    rank = F.rank().over(Window.partitionBy(*matching).orderBy(F.desc("numerator")))
    return g.withColumn("numerator", checked).select(*matching, item, "numerator", "denominator", rank.alias("rank"), (rank == 1).alias("leads"))


def inclusion(members: DataFrame, graph: list[str], matching: str, edge: list[str]) -> DataFrame:
    """How many of a graph's matchings hold an edge, and their share."""
    all_of = members.groupBy(*graph).agg(F.count_distinct(matching).alias("matchings"))
    held = members.groupBy(*graph, *edge).agg(F.count_distinct(matching).alias("held"))
    return held.join(all_of, graph).withColumn("frequency", F.col("held") / F.col("matchings"))


def leader_class(leaders: DataFrame, by: list[str]) -> DataFrame:
    """How often an item leads over the enumerated matchings: necessary, possible or impossible leader."""
    g = leaders.groupBy(*by).agg(F.bool_and("leads").alias("always"), F.bool_or("leads").alias("ever"), F.count_if("leads").alias("times"), F.count("*").alias("matchings"))
    return g.select(*by, "times", "matchings", F.when(F.col("always"), "necessary").when(F.col("ever"), "possible").otherwise("impossible").alias("leader_class"))


def matching_dependence(adjusted: DataFrame, pair: list[str], matching: str, alpha: float) -> DataFrame:
    """Does the decision on a pair (adjusted p of Holm inside each matching) depend on the matching; with a witness of each kind (the first by name)."""
    rejects = F.coalesce(F.col("adjusted") <= alpha, F.lit(False))
    g = adjusted.groupBy(*pair).agg(
        F.count("*").alias("matchings"), F.count_if(rejects).alias("rejecting"), F.min(F.when(rejects, F.col(matching))).alias("rejecting_matching"), F.min(F.when(~rejects, F.col(matching))).alias("other_matching"),
    )
    return g.withColumn("dependent", (F.col("rejecting") > 0) & (F.col("rejecting") < F.col("matchings")))


def sign_bounds(tails: DataFrame, pair: list[str]) -> DataFrame:
    """Least and most wins of a pair over matchings, its ties if all matchings have as many, and its smallest and largest raw p."""
    g = tails.groupBy(*pair).agg(F.min("wins").alias("least_wins"), F.max("wins").alias("most_wins"), F.min("ties").alias("_t0"), F.max("ties").alias("_t1"), F.min("p").alias("best_p"), F.max("p").alias("worst_p"))
    return g.select(*pair, "least_wins", "most_wins", F.when(F.col("_t0") == F.col("_t1"), F.col("_t0")).alias("constant_ties"), "best_p", "worst_p")


def candidate_edges(samples: DataFrame, wave: str, batch: str, pool: str, first: str, last: str) -> DataFrame:
    """(wave, batch): waves that have samples of the role EVAL on the first and on the last day in one batch and one pool; batches that training used are left out."""
    at = lambda day: samples.where((F.col("day") == day) & (F.col("role") == "EVAL")).select(wave, batch, pool).distinct()
    trained = samples.where("role = 'TRAIN'").select(batch).distinct()
    return at(first).join(at(last), [wave, batch, pool], "left_semi").join(trained, batch, "left_anti").select(wave, batch).distinct()


def work_accounting(usage: DataFrame, receipts: DataFrame) -> DataFrame:
    """Work of each rule, of each rule and partition, and of all rules together (nulls), every receipt and control counted once in each.

    ``usage`` (rule, partition, receipt, control, scored) has a row for each control that a rule's score used
    through a receipt (one inference); ``receipts`` (receipt, forwards, cached, seconds) one for each inference.
    controls: distinct ones; forwards and seconds: of distinct receipts; executed_forwards: of those not taken
    from a cache; uncached_forwards: of all uses, as if nothing were kept; scored: distinct scored values.
    """
    sets = usage.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("p")) for a, b in ((True, True), (True, False), (False, False))])).alias("_s"))
    sets = sets.withColumn("rule", F.when(F.col("_s.r"), F.col("rule"))).withColumn("partition", F.when(F.col("_s.p"), F.col("partition"))).drop("_s")
    key = ["rule", "partition"]
    one = receipts.select("receipt", "forwards", "cached", "seconds")
    uses = sets.join(one.select("receipt", "forwards"), "receipt", "left").groupBy(*key).agg(F.count_distinct("control").alias("controls"), F.count_distinct("scored").alias("scored"), F.sum("forwards").alias("uncached_forwards"))
    each = sets.select(*key, "receipt").distinct().join(one, "receipt", "left").groupBy(*key)
    work = each.agg(F.count("*").alias("receipts"), F.count_if("cached").alias("cached_receipts"), F.sum("forwards").alias("forwards"), F.sum(F.when(~F.col("cached"), F.col("forwards")).otherwise(0)).alias("executed_forwards"), F.sum("seconds").alias("seconds"))
    own = work.select(*[F.col(c).alias(f"_j_{c}") for c in key], *[c for c in work.columns if c not in key])
    return uses.join(own, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in key]).drop(*[f"_j_{c}" for c in key])


def rejection_class(adjusted: DataFrame, pair: list[str], family: list[str], alpha: float) -> DataFrame:
    """Is a pair's rejection the same under every matching: invariant, impossible, possible_not_necessary or unresolved.
    The size of a matching's family is its number of rows; the largest one counts."""
    g = adjusted.withColumn("_m", F.count("*").over(Window.partitionBy(*family))).groupBy(*pair).agg(F.min("p").alias("best"), F.max("p").alias("worst"), F.bool_or(F.col("adjusted") <= alpha).alias("some"), F.max("_m").alias("size"))
    kind = F.when(F.col("worst") * F.col("size") <= alpha, "invariant").when(F.col("best") > alpha, "impossible").when(F.col("some"), "possible_not_necessary").otherwise("unresolved")
    return g.select(*pair, kind.alias("class"))
