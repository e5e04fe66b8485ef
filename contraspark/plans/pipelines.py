"""Queries: whole pipelines, composed of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contraspark.operators import allocation as al
from contraspark.operators import comparison as cm
from contraspark.operators import inference as inf
from contraspark.operators import organizer as og
from contraspark.operators import publication as pu
from contraspark.operators import quality as dq
from contraspark.operators import reporting as rp
from contraspark.operators import scoring as sc
from contraspark.operators.prefix import running
from contraspark.plans import base, decisions, extended, reports, role_scores
from contraspark.plans import domain as dm
from contraspark.plans.domain import with_
from contraspark.plans.registry import query
from contraspark.sources import storage as st

R, B = role_scores.R, decisions._BASE

# ---- protocol: prepare, run, score ---------------------------------------------------------------


@query("pipeline_prepare_protocol", R + r""", t AS (SELECT stratum AS task, count(*) AS treated_cells FROM halves WHERE half = 'target' GROUP BY stratum),
m AS (SELECT allocation, depth, block, count(*) AS block_cells, sha256(string_agg(cell_id, chr(10) ORDER BY cell_id)) AS digest FROM member GROUP BY ALL),
n AS (SELECT task, allocation, depth, block, sqrt(sum(pow(y - value, 2))) AS effect_norm FROM ltargets JOIN lblocks USING (gene) GROUP BY ALL)
SELECT task, allocation, depth, block, treated_cells, block_cells, digest, effect_norm FROM n JOIN t USING (task) JOIN m USING (allocation, depth, block)""", ("effect_norm",))
def prepare_protocol(spark, d):
    """Pools and their targets, allocated blocks with their membership digests, and the size of each target's effect against each block.

    Nothing is returned unless the membership passes its checks.
    """
    members = dm.kept(dm.membership(spark, d), "membership")
    wrong = dq.membership(members, dm.controls(spark, d)).limit(5).collect()
    if wrong:
        raise ValueError(f"the membership fails its checks: {wrong}")
    treated = dm.halves(spark, d).where("half = 'target'").groupBy(F.col("stratum").alias("task")).agg(F.count("*").alias("treated_cells"))
    key = ["allocation", "depth", "block"]
    pools = members.groupBy(*key).agg(F.count("*").alias("block_cells")).join(st.membership_digest(members, key, "cell_id"), key)
    blocks = sc.mean_profile(members.join(dm.controls(spark, d).drop("stratum"), "cell_id"), key)
    effects = dm.targets(spark, d).crossJoin(F.broadcast(blocks))  # few blocks
    e = sc.minus("treated", "profile")
    effects = effects.select("task", *key, F.sqrt(sc.dot(e, e)).alias("effect_norm"))
    return effects.join(treated, "task").join(pools, key).select("task", *key, "treated_cells", "block_cells", "digest", "effect_norm")


@query("pipeline_run_protocol", R + role_scores._PRIMARY + role_scores._ROOT + "SELECT x.depth, x.target, x.model AS model_a, y.model AS model_b, x.mse AS loss_a, y.mse AS loss_b, y.mse - x.mse AS margin FROM o x JOIN o y ON x.depth = y.depth AND x.target = y.target AND x.model < y.model", ("loss_a", "loss_b", "margin"))
def run_protocol(spark, d):
    """Primary scores, their means up the hierarchy (allocations, then tasks), and the margins of all model pairs."""
    key = ["depth", "target"]
    o = cm.chained_mean(sc.primary_scores(dm.tuple_scores(spark, d)), ["allocation", "task"], ["depth", "model", "target"], "mse")
    a, b = o.alias("a"), o.alias("b")
    j = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key] + [F.col("a.model") < F.col("b.model")])
    loss = [F.col("a.mse").alias("loss_a"), F.col("b.mse").alias("loss_b"), (F.col("b.mse") - F.col("a.mse")).alias("margin")]
    return j.select(*[f"a.{c}" for c in key], F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), *loss)


@query("pipeline_score", R + """, x AS (SELECT *, CASE WHEN kind_a <> kind_b THEN v ELSE 0 END AS moved FROM pairs JOIN vdist USING (allocation, depth))
SELECT task, allocation, depth, model_a, model_b, d_s, d_d, v, applicable, CASE WHEN applicable THEN d_s + moved END AS predicted, CASE WHEN applicable THEN abs(d_d - d_s - moved) <= 1e-9 + 1e-9 * greatest(abs(d_d), abs(d_s), moved) END AS holds,
CASE WHEN abs(d_s) <= 1e-12 OR abs(d_d) <= 1e-12 THEN 'numerical_tie' WHEN d_s > 0 AND d_d > 0 THEN CASE WHEN kind_a <> kind_b THEN 'effect_preferred_both' ELSE 'a_preferred_both' END
WHEN d_s < 0 AND d_d < 0 THEN CASE WHEN kind_a <> kind_b THEN 'state_preferred_both' ELSE 'b_preferred_both' END WHEN kind_a = kind_b OR NOT applicable THEN 'ranking_reversal' WHEN d_s < 0 THEN 'state_to_effect' ELSE 'unexpected_reversal' END AS label FROM x""", ("d_s", "d_d", "v", "predicted"))
def score(spark, d):
    """Role tuples to patterns to pairs, for all allocations and depths: margins, the identity's prediction and check, and the crossing's label."""
    pairs = dm.kept(sc.crossing(sc.pair_margins(sc.pattern_mse(dm.tuple_scores(spark, d)))), "pairs")
    key = ["task", "allocation", "depth", "model_a", "model_b"]
    checked = sc.identity_check(pairs, role_scores._distance(spark, d)).drop("d_s", "d_d", "applicable")
    moved = F.when(F.col("kind_a") != F.col("kind_b"), F.col("v")).otherwise(0.0)
    j = pairs.join(checked, key).withColumn("predicted", F.when(F.col("applicable"), F.col("d_s") + moved))
    return j.select(*key, "d_s", "d_d", "v", "applicable", "predicted", "holds", "label")


# ---- organizer -----------------------------------------------------------------------------------


@query("pipeline_organizer_design", B + decisions._REC + """SELECT d.case_id, d.unit, d.budget, d.model_a, d.model_b, d.policy, d.margin, d."limit", d.released, d.favoured, CASE WHEN held IS NOT NULL THEN held WHEN released THEN 'margin_exceeds_range_and_gap' ELSE 'margin_within_range_or_gap' END AS reason,
r.budget AS recommended_budget, r.winner FROM dec d JOIN rec r USING (case_id, policy)""", ("margin", '"limit"'))
def organizer_design(spark, d):
    """Calibration on development cases, decisions on the anchors of the others, and the smallest budget that settles a winner."""
    decided = dm.kept(decisions._decided(spark, d), "decisions")
    advice = og.budget_recommendation(decided, 5, ["A", "N", "R"]).withColumnRenamed("budget", "recommended_budget")
    return decided.join(advice, ["case_id", "policy"]).select("case_id", "unit", "budget", "model_a", "model_b", "policy", "margin", "limit", "released", "favoured", "reason", "recommended_budget", "winner")


@query("pipeline_organizer_check", B + decisions._PS + decisions._REC + f""", g AS (SELECT g.budget, {decisions._VERDICT} FROM ps2 g JOIN ps2 r USING (budget) WHERE g.policy = 'geometry_scaled' AND r.policy = 'repeated_primary'),
ba AS (SELECT r.case_id, r.policy, r.budget, bool_and(a.supported) AS supported FROM rec r JOIN ass a ON a.case_id = r.case_id AND a.policy = r.policy AND a.budget = r.budget AND (a.model_a = r.winner OR a.model_b = r.winner) GROUP BY ALL),
bb AS (SELECT budget, policy, count(*) AS recommended, count(*) FILTER (supported) AS supported_recommendations FROM ba GROUP BY ALL)
SELECT ps2.*, verdict, coalesce(recommended, 0) AS recommended, coalesce(supported_recommendations, 0) AS supported_recommendations, 0::BIGINT AS frozen_differences FROM ps2 JOIN g USING (budget) LEFT JOIN bb USING (budget, policy)""", ("coverage", "unsupported_share"))
def organizer_check(spark, d):
    """A frozen design against its recomputation, then against all realizations of the assessment: support of each policy, the
    verdict of the adaptive one, and how many recommended budgets hold against all opponents."""
    frozen = st.publish_once(decisions._decided(spark, d), st.work_path(spark, "design"))
    differences = F.broadcast(st.frozen_check(decisions._decided(spark, d), frozen).agg(F.count("*").alias("frozen_differences")))  # one row
    assessed = dm.kept(og.assess(frozen, dm.assessment(spark, d), decisions.GAP), "assessed")
    summary = dm.kept(og.policy_summary(assessed), "summary")
    advice = og.budget_recommendation(frozen, 5, ["A", "N", "R"]).where("winner is not null")
    own = advice.join(assessed, ["case_id", "policy", "budget"]).where("model_a = winner or model_b = winner").groupBy("case_id", "policy", "budget").agg(F.bool_and("supported").alias("ok"))
    own = own.groupBy("budget", "policy").agg(F.count("*").alias("recommended"), F.count_if("ok").alias("supported_recommendations"))
    j = summary.join(og.compare_policies(summary), "budget").join(own, ["budget", "policy"], "left").crossJoin(differences)
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(*summary.columns, "verdict", none("recommended"), none("supported_recommendations"), "frozen_differences")


# ---- reporting rules, design audit, selection ----------------------------------------------------


_PLAN = """, b AS (SELECT rule, block, count(*) AS rows FROM tb GROUP BY ALL), c AS (SELECT rule, (sum(rows) OVER (PARTITION BY rule ORDER BY block ROWS UNBOUNDED PRECEDING))::BIGINT AS count FROM b),
g AS (SELECT max(count) FILTER (count <= 0.5 * (SELECT count(*) FROM wh)) AS published FROM (SELECT count FROM c GROUP BY count HAVING count(DISTINCT rule) = 5)),
o AS (SELECT rule, model_a, model_b, row_number() OVER (PARTITION BY rule ORDER BY score DESC, model_a, model_b) AS k FROM eg),
dp AS (SELECT pd.rule, model_a, model_b, CASE WHEN k <= published THEN direction ELSE 'hold' END AS direction, lower, upper FROM pd LEFT JOIN o USING (rule, model_a, model_b) LEFT JOIN iv USING (model_a, model_b), g WHERE pd.rule <> 'cross_fitting_first_partition')
"""


@query("pipeline_reporting_rules", reports._PUB + ", " + reports._IV.rstrip() + reports._TB + _PLAN + f""", x AS (SELECT rule, direction, lower, upper, {reports._OUT} AS outcome FROM dp)
SELECT rule, count(*) FILTER (outcome <> 'hold') AS published, count(*) FILTER (outcome <> 'hold') / count(*) AS coverage, count(*) FILTER (outcome = 'supported') AS supported, count(*) FILTER (outcome = 'reversed') AS reversed, count(*) FILTER (outcome = 'unresolved') AS unresolved,
CASE WHEN count(*) FILTER (outcome <> 'hold') > 0 THEN count(*) FILTER (outcome = 'reversed') / count(*) FILTER (outcome <> 'hold') END AS reversal_share, {reports._BOUNDS} FROM x GROUP BY rule""", ("coverage", "reversal_share"))
def reporting_rules(spark, d):
    """Calibration, candidates of the five rules, the coverage that all can attain, and each rule's publications at it held against later intervals."""
    models = ["model_a", "model_b"]
    m = F.broadcast(extended.common_counts(spark, d).where("primary").agg(F.max("count").alias("m")))  # one row
    ranked = running(reports._eligible(spark, d), ["rule"], [F.desc("score"), *models], rank="k").select("rule", *models, "k")
    c = reports._candidates(spark, d).where(F.col("rule") != pu.COMPANION).join(ranked, ["rule", *models], "left").crossJoin(m)
    directions = dm.kept(c.select("rule", *models, F.when(F.col("k") <= F.col("m"), F.col("direction")).otherwise("hold").alias("direction")), "directions")
    intervals = dm.kept(reports._intervals(spark, d), "intervals")
    of = lambda x: F.count_if(F.col("outcome") == x)
    n = F.count_if(F.col("outcome") != "hold")
    counts = rp.classify_directions(directions, intervals, models).groupBy("rule").agg(
        n.alias("published"), (n / F.count("*")).alias("coverage"), of("supported").alias("supported"), of("reversed").alias("reversed"), of("unresolved").alias("unresolved"), F.when(n > 0, of("reversed") / n).alias("reversal_share"),
    )
    return counts.join(rp.reversal_bounds(directions, intervals, models, ["rule"]), "rule")


@query("pipeline_design_audit", decisions.U + """, m AS (SELECT DISTINCT method_id FROM util), a AS (SELECT DISTINCT allocation_id FROM util), u AS (SELECT allocation_id, method_id, count(DISTINCT unit_id) AS units FROM util GROUP BY ALL)
SELECT a.allocation_id, x.method_id AS source, y.method_id AS target, least(coalesce(ux.units, 0), coalesce(uy.units, 0)) AS units,
(SELECT count(DISTINCT s.s_nationkey) FROM supplier s JOIN supplier t ON round(s.s_acctbal / 100) = round(t.s_acctbal / 100) AND s.s_nationkey <> t.s_nationkey WHERE s.s_nationkey::VARCHAR IN (SELECT unit_id FROM util v WHERE v.allocation_id = a.allocation_id)) AS linked_units, coalesce(h.k, 0) AS k, round(h.adjusted, 6) AS adjusted,
CASE WHEN h.k IS NULL OR h.k < ceil(log2(h.m / 0.05) - 1e-12) THEN 'WITHHELD' WHEN h.adjusted <= 0.05 THEN 'DIRECTION' ELSE 'NO_DIRECTION' END AS decision
FROM a, m x, m y LEFT JOIN u ux ON ux.allocation_id = a.allocation_id AND ux.method_id = x.method_id LEFT JOIN u uy ON uy.allocation_id = a.allocation_id AND uy.method_id = y.method_id
LEFT JOIN hm h ON h.allocation_id = a.allocation_id AND h.source = x.method_id AND h.target = y.method_id WHERE x.method_id <> y.method_id""", ("adjusted",))
def design_audit(spark, d):
    """The units' audit (how many share an acquisition group with another), the plan of all ordered pairs, the units that bear on each, exact sign tails, Holm's adjustment and the decision; pairs without data are withheld."""
    u = dm.utilities(spark, d)
    tails = inf.sign_tails(inf.sign_counts(u)).withColumn("p", F.round("p", 10))
    decided = inf.directional(inf.holm(tails, ["allocation_id"], "p", ["source", "target"]), 0.05, ["allocation_id"])
    units = u.groupBy("allocation_id", "method_id").agg(F.count_distinct("unit_id").alias("units"))
    method = u.select("method_id").distinct()
    key = ["allocation_id", "source", "target"]
    plan = u.select("allocation_id").distinct().crossJoin(method.withColumnRenamed("method_id", "source")).crossJoin(method.withColumnRenamed("method_id", "target")).where("source <> target")  # rosters
    for side in ("source", "target"):
        plan = plan.join(units.select("allocation_id", F.col("method_id").alias(side), F.col("units").alias(f"units_{side}")), ["allocation_id", side], "left")
    out = plan.join(decided.select(*key, "k", "adjusted", "decision"), key, "left")
    least = F.least(F.coalesce("units_source", F.lit(0)), F.coalesce("units_target", F.lit(0)))
    linked = decisions.unit_geometry(spark, d).where("neighbours > 0").select(F.col("unit").cast("string").alias("unit_id"))
    linked = u.select("allocation_id", "unit_id").distinct().join(linked, "unit_id", "left_semi").groupBy("allocation_id").agg(F.count("*").alias("linked_units"))
    out = out.join(linked, "allocation_id", "left")
    return out.select(*key, least.alias("units"), F.coalesce("linked_units", F.lit(0)).alias("linked_units"), F.coalesce("k", F.lit(0)).alias("k"), F.round("adjusted", 6).alias("adjusted"), F.coalesce("decision", F.lit("WITHHELD")).alias("decision"))


# ---- fixed-budget scores over the rules' partitions ------------------------------------------------

#: Weights of genes, growing with their place and summing to one; a family's states are a multiple of a control's profile.
FAMILIES = (("no_change", 1.0), ("mild", 1.25), ("strong", 1.5), ("double", 2.0))
_SCALED = """, e AS (SELECT vec_id::VARCHAR AS cell_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS gene FROM embeddings), y AS (SELECT label AS task, gene, avg(v) AS y FROM e WHERE label >= 4 GROUP BY ALL),
s AS (SELECT gene, greatest(stddev_samp(v), 0.1) AS s, (gene + 1.0::DOUBLE) / (SELECT sum(gene + 1.0::DOUBLE) FROM (SELECT DISTINCT gene FROM e)) AS w FROM e WHERE label < 4 GROUP BY gene),
fam(family, factor) AS (VALUES ('no_change', 1.0::DOUBLE), ('mild', 1.25), ('strong', 1.5), ('double', 2.0))"""
_RULE_LOSS = base._RULE_CELLS + _SCALED + """, m AS (SELECT rule, direction, gene, avg(v) FILTER (role = 'input') AS given, avg(v) FILTER (role = 'observation') AS ref FROM rp JOIN e USING (cell_id) GROUP BY ALL),
l AS (SELECT task, rule, direction, family, sum(w * pow(((factor - 1) * given - (y - ref)) / s, 2)) AS loss FROM m JOIN y USING (gene) JOIN s USING (gene), fam GROUP BY ALL)
"""


def _families(spark):
    return spark.createDataFrame(FAMILIES, "family string, factor double")


def _weighted_scales(spark, d):
    s = dm.scales(spark, d).select(F.posexplode("scale").alias("gene", "s"))
    place = F.col("gene") + F.lit(1.0)
    total = F.broadcast(s.agg(F.sum(place).alias("_t")))  # one row
    return dm.kept(s.crossJoin(total).select("gene", "s", (place / F.col("_t")).alias("w")), "scales")


def _partition_losses(spark, d, share=1.0):
    return sc.partition_losses(base._rule_cells(spark, d, share), dm.controls(spark, d), _families(spark), dm.targets_of_all(spark, d), _weighted_scales(spark, d))


@query("fixed_budget_score", _RULE_LOSS + "SELECT task, rule, family, avg(loss) AS loss, count(*) AS directions FROM l GROUP BY ALL", ("loss",))
def fixed_budget_score(spark, d):
    """Weighted loss of each family under every rule, over the whole budget: squared in each direction, then averaged."""
    return _partition_losses(spark, d).groupBy("task", "rule", "family").agg(F.avg("loss").alias("loss"), F.count("*").alias("directions"))


@query("independent_effect_score", base._RULE_CELLS + _SCALED + """, q AS (SELECT cell_id, CASE WHEN r % 3 = 0 THEN 'input' ELSE 'observation' END AS role FROM rk WHERE r % 3 < 2),
m AS (SELECT gene, avg(v) FILTER (role = 'input') AS given, avg(v) FILTER (role = 'observation') AS ref FROM q JOIN e USING (cell_id) GROUP BY ALL)
SELECT task, family, sum(w * pow(((factor - 1) * given - (y - ref)) / s, 2)) AS loss FROM m JOIN y USING (gene) JOIN s USING (gene), fam GROUP BY ALL""", ("loss",))
def independent_effect_score(spark, d):
    """The same loss on rows that the user names for each role (thirds of each stratum; the last third has none); a row in both roles, or twice in one, is an error."""
    r = running(dm.controls(spark, d).select("cell_id", "stratum"), ["stratum"], [al.hash_rank(dm.SEED, F.lit("0"), "cell_id"), "cell_id"], rank="r").where("(r - 1) % 3 < 2")
    cells = r.select(F.lit("own").alias("rule"), F.lit(0).alias("direction"), F.when((F.col("r") - 1) % 3 == 0, "input").otherwise("observation").alias("role"), "cell_id")
    sc.refuse_overlap(cells)
    return sc.partition_losses(cells, dm.controls(spark, d), _families(spark), dm.targets_of_all(spark, d), _weighted_scales(spark, d)).select("task", "family", "loss")


_SHARES = (("whole", 1.0), ("half", 0.5))


@query("pipeline_fixed_budget_selection", _RULE_LOSS.replace("rp AS (SELECT rule, direction, role, stratum, cell_id FROM (SELECT *, n // 4 AS q FROM rk) JOIN parts", "sh(budget, share) AS (VALUES ('whole', 1.0::DOUBLE), ('half', 0.5::DOUBLE)),\nrp AS (SELECT budget, rule, direction, role, stratum, cell_id FROM (SELECT *, floor(n * share / 4)::BIGINT AS q FROM rk, sh) JOIN parts")
       .replace("m AS (SELECT rule,", "m AS (SELECT budget, rule,").replace("l AS (SELECT task, rule,", "l AS (SELECT task, budget, rule,") + """, t AS (SELECT budget, rule, family, task, avg(loss) AS loss FROM l GROUP BY ALL),
p AS (SELECT budget, rule, family, CASE WHEN task % 2 = 0 THEN 'selection' ELSE 'evaluation' END AS part, avg(loss) AS loss FROM t GROUP BY ALL),
o(family, place) AS (VALUES ('no_change', 1), ('mild', 2), ('strong', 3), ('double', 4)),
c AS (SELECT budget, rule, arg_min(family, place) AS family FROM (SELECT *, min(loss) OVER (PARTITION BY budget, rule) AS best FROM p JOIN o USING (family) WHERE part = 'selection') WHERE loss <= best + 1e-12 GROUP BY ALL),
b AS (SELECT budget, rule, min(loss) AS best_loss FROM p WHERE part = 'evaluation' GROUP BY ALL)
SELECT budget, rule, family, x.loss AS selection_loss, z.loss AS evaluation_loss, best_loss, z.loss - best_loss AS regret FROM c JOIN p x USING (budget, rule, family) JOIN p z USING (budget, rule, family) JOIN b USING (budget, rule) WHERE x.part = 'selection' AND z.part = 'evaluation'""", ("selection_loss", "evaluation_loss", "best_loss", "regret"))
def fixed_budget_selection(spark, d):
    """For each budget and rule the family of least mean loss on selection tasks, and its loss and regret on the other tasks.

    Budgets are shares of each stratum's controls, rounded down to multiples of four; the rules' partitions
    give the losses. Tasks are disjoint between the stages; ties go to the family declared first.
    """
    losses = reduce(DataFrame.union, [_partition_losses(spark, d, share).select(F.lit(name).alias("budget"), "rule", "direction", "family", "task", "loss") for name, share in _SHARES])
    part = F.when(F.col("task") % 2 == 0, "selection").otherwise("evaluation")
    means = cm.chained_mean(losses.withColumn("part", part), ["direction", "task"], ["budget", "rule", "family", "part"], "loss")
    means = dm.kept(means, "losses")
    key = ["budget", "rule"]
    chosen = cm.fixed_argmin(means.where("part = 'selection'"), key, "family", "loss", order=[f for f, _ in FAMILIES])
    evaluated = means.where("part = 'evaluation'")
    best = evaluated.groupBy(*key).agg(F.min("loss").alias("best_loss"))
    own = chosen.join(evaluated.select(*key, "family", F.col("loss").alias("evaluation_loss")), [*key, "family"])
    return own.join(best, key).select(*key, "family", F.col("loss").alias("selection_loss"), "evaluation_loss", "best_loss", (F.col("evaluation_loss") - F.col("best_loss")).alias("regret"))
