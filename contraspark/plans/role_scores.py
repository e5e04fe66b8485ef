"""Queries: scoring under role assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from contraspark.operators import comparison as cm
from contraspark.operators import scoring as sc
from contraspark.plans import domain as dm
from contraspark.plans.domain import with_
from contraspark.plans.registry import query

R = with_("role")


@query("role_tuple_mse", R + "SELECT * FROM tuples", ("mse",))
def _(spark, d):
    return dm.tuple_scores(spark, d)


def _patterns(spark, d):
    return sc.pattern_mse(dm.tuple_scores(spark, d))


@query("pattern_mse", R + "SELECT * FROM patterns", ("mse",))
def _(spark, d):
    return _patterns(spark, d)


def _distance(spark, d):
    return sc.reference_distance(dm.blocks(spark, d), dm.scales(spark, d))


@query("reference_distance_v", R + "SELECT * FROM vdist", ("v",))
def _(spark, d):
    return _distance(spark, d)


def _pairs(spark, d):
    return sc.pair_margins(_patterns(spark, d))


@query("pair_margins", R + "SELECT * FROM pairs", ("d_s", "d_d"))
def _(spark, d):
    return _pairs(spark, d)


@query("identity_check", R + """SELECT task, allocation, depth, model_a, model_b, d_s, d_d, v, applicable, CASE WHEN applicable THEN abs(d_d - (d_s + CASE WHEN kind_a <> kind_b THEN v ELSE 0 END)) <= 1e-9 + 1e-9 * greatest(abs(d_d), abs(d_s), CASE WHEN kind_a <> kind_b THEN v ELSE 0 END) END AS holds
FROM pairs JOIN vdist USING (allocation, depth)""", ("d_s", "d_d", "v"))
def _(spark, d):
    return sc.identity_check(_pairs(spark, d), _distance(spark, d))


@query("crossing_classification", R + """SELECT *, CASE WHEN abs(d_s) <= 1e-12 OR abs(d_d) <= 1e-12 THEN 'numerical_tie' WHEN d_s > 0 AND d_d > 0 THEN CASE WHEN kind_a = 'effect' AND kind_b = 'state' THEN 'effect_preferred_both' ELSE 'a_preferred_both' END
WHEN d_s < 0 AND d_d < 0 THEN CASE WHEN kind_a = 'effect' AND kind_b = 'state' THEN 'state_preferred_both' ELSE 'b_preferred_both' END
WHEN kind_a = kind_b OR NOT applicable THEN 'ranking_reversal' WHEN d_s < 0 THEN 'state_to_effect' ELSE 'unexpected_reversal' END AS label FROM pairs""", ("d_s", "d_d"))
def _(spark, d):
    return sc.crossing(_pairs(spark, d))


@query("pattern_rankings", R + """SELECT a.task, a.allocation, a.depth, a.pattern, a.model, count(*) FILTER (a.mse - b.mse > 1e-12) + 1 AS rank, bool_or(a.model <> b.model AND abs(a.mse - b.mse) <= 1e-12) AS tied
FROM patterns a JOIN patterns b USING (task, allocation, depth, pattern) GROUP BY ALL""")
def _(spark, d):
    return sc.tolerant_ranks(_patterns(spark, d), ["task", "allocation", "depth", "pattern"], "model", "mse")


_PRIMARY = """, prim AS (SELECT task, allocation, depth, model, CASE WHEN kind = 'effect' AND observation = 'B2' THEN 'heldout_effect' WHEN kind = 'effect' THEN 'shared_effect' ELSE 'treated_state' END AS target, mse
FROM tuples WHERE input = 'B1' AND prediction = 'B1' AND (observation = 'B1' OR (observation = 'B2' AND kind = 'effect')))\n"""


@query("protocol_primary_score", R + _PRIMARY + "SELECT * FROM prim", ("mse",))
def _(spark, d):
    return sc.primary_scores(dm.tuple_scores(spark, d))


@query("complement_observation_score", R + """, o AS (SELECT a.allocation, a.depth, a.block AS input, a.gene, avg(b.value) AS c FROM lblocks a JOIN lblocks b ON a.allocation = b.allocation AND a.depth = b.depth AND a.gene = b.gene AND a.block <> b.block GROUP BY ALL),
m AS (SELECT task, model, allocation, depth, input, avg(pow((p - (y - o.c)) / s, 2)) AS mse FROM lpred JOIN ltargets USING (task, gene) JOIN o USING (gene) JOIN lcontrol USING (gene) WHERE kind = 'effect' GROUP BY ALL)
SELECT task, model, depth, avg(mse) AS mse, count(*) AS n FROM m GROUP BY ALL""", ("mse",))
def _(spark, d):
    return sc.complement_scores(dm.targets(spark, d), dm.blocks(spark, d), dm.predictions(spark, d), dm.scales(spark, d))


def _observed(spark, d):
    """Observed effects (target half minus all controls) and predicted effects of every model."""
    control = sc.mean_profile(dm.controls(spark, d).withColumn("one", F.lit(1)), ["one"]).select(F.col("profile").alias("c"))
    obs = dm.targets(spark, d).crossJoin(F.broadcast(control)).select("task", sc.minus("treated", "c").alias("observed"))
    pred = dm.predictions(spark, d).crossJoin(F.broadcast(control))
    return obs, pred.select("task", "model", F.when(F.col("kind") == "effect", F.col("prediction")).otherwise(sc.minus("prediction", "c")).alias("predicted"))


_OBS = """, obs AS (SELECT task, gene, y - c AS y FROM ltargets JOIN lcontrol USING (gene)), prd AS (SELECT task, model, gene, CASE WHEN kind = 'effect' THEN p ELSE p - c END AS f FROM lpred JOIN lcontrol USING (gene)),
bth AS (SELECT task, model, gene, y, f, s FROM obs JOIN prd USING (task, gene) JOIN lcontrol USING (gene))\n"""


@query("standardized_utility", R + _OBS + "SELECT task, model, -sum(pow((f - y) / s, 2)) AS utility_sum, -sum((gene + 1) / (SELECT sum(gene + 1.0::DOUBLE) FROM lcontrol) * pow((f - y) / s, 2)) AS utility_weighted FROM bth GROUP BY ALL", ("utility_sum", "utility_weighted"))
def _(spark, d):
    """Weights grow with a gene's place and sum to one."""
    scales = dm.scales(spark, d)
    place = F.transform(F.sequence(F.lit(1), F.size("scale")), lambda i: i / (F.size("scale") * (F.size("scale") + 1) / 2))
    return sc.standardized_utility(*_observed(spark, d), scales, weights=scales.select(place.alias("weight"))).select("task", "model", "utility_sum", "utility_weighted")


@query("negative_mse_scale_floor", R + _OBS + "SELECT task, model, -avg(pow((f - y) / greatest(s, 0.15), 2)) AS utility_mean FROM bth GROUP BY ALL", ("utility_mean",))
def _(spark, d):
    return sc.standardized_utility(*_observed(spark, d), dm.scales(spark, d), 0.15).select("task", "model", "utility_mean")


_MET = """, met AS (SELECT task, model, sqrt(avg(pow(f - y, 2))) AS rmse, avg(abs(f - y)) AS mae, avg(y * y) - pow(avg(y), 2) AS vy, avg(f * f) - pow(avg(f), 2) AS vf, avg(y * f) - avg(y) * avg(f) AS cov, sum(y * y) AS yy, sum(f * f) AS ff, sum(y * f) AS yf FROM bth GROUP BY ALL)\n"""


@query("delta_metrics", R + _OBS + _MET + "SELECT task, model, rmse, CASE WHEN vy > 1e-18 AND vf > 1e-18 THEN greatest(least(cov / sqrt(vy * vf), 1), -1) END AS pearson FROM met", ("rmse", "pearson"))
def _(spark, d):
    return sc.profile_metrics(*_observed(spark, d)).select("task", "model", "rmse", "pearson")


@query("effect_vector_metrics", R + _OBS + _MET + "SELECT task, model, mae, sqrt(yy) AS magnitude_observed, sqrt(ff) AS magnitude_predicted, sqrt(ff) / sqrt(yy) AS magnitude_ratio, CASE WHEN yy > 1e-18 AND ff > 1e-18 THEN greatest(least(yf / sqrt(yy * ff), 1), -1) END AS cosine FROM met",
       ("mae", "magnitude_observed", "magnitude_predicted", "magnitude_ratio", "cosine"))
def _(spark, d):
    return sc.profile_metrics(*_observed(spark, d)).drop("rmse", "pearson")


@query("centroid_retrieval", R + _OBS + """, dist AS (SELECT p.task, p.model, o.task AS candidate, sum(pow(p.f - o.y, 2)) AS d2 FROM prd p JOIN obs o USING (gene) GROUP BY ALL)
SELECT a.task, a.model, avg((a.d2 > b.d2)::INT) AS retrieval FROM dist a JOIN dist b ON a.task = b.task AND a.model = b.model AND b.candidate = b.task WHERE a.candidate <> a.task GROUP BY ALL""", ("retrieval",))
def _(spark, d):
    return sc.centroid_retrieval(*_observed(spark, d))


@query("state_effect_convert", R + "SELECT task, model, gene::INT AS gene, CASE WHEN kind = 'state' THEN p - c ELSE p END AS effect, CASE WHEN kind = 'state' THEN p ELSE p + c END AS state FROM lpred JOIN lcontrol USING (gene)", ("effect", "state"))
def _(spark, d):
    control = sc.mean_profile(dm.controls(spark, d).withColumn("one", F.lit(1)), ["one"]).select(F.col("profile").alias("c"))
    p = dm.predictions(spark, d).crossJoin(F.broadcast(control)).select("task", "model", "kind", F.posexplode(F.arrays_zip("prediction", "c")).alias("gene", "x"))
    state = F.col("kind") == "state"
    return p.select("task", "model", "gene", F.when(state, F.col("x.prediction") - F.col("x.c")).otherwise(F.col("x.prediction")).alias("effect"), F.when(state, F.col("x.prediction")).otherwise(F.col("x.prediction") + F.col("x.c")).alias("state"))


@query("single_role_contrasts", R + """, c AS (SELECT 'observation' AS role, a.task, a.allocation, a.depth, a.model, b.mse - a.mse AS x FROM tuples a JOIN tuples b USING (task, allocation, depth, model, prediction, input) WHERE a.observation <> b.observation
UNION ALL SELECT 'prediction', a.task, a.allocation, a.depth, a.model, b.mse - a.mse FROM tuples a JOIN tuples b USING (task, allocation, depth, model, observation, input) WHERE a.prediction <> b.prediction
UNION ALL SELECT 'input', a.task, a.allocation, a.depth, a.model, b.mse - a.mse FROM tuples a JOIN tuples b USING (task, allocation, depth, model, observation, prediction) WHERE a.input <> b.input)
SELECT task, allocation, depth, model, role, count(*) AS n, avg(abs(x)) AS mean_abs, min(x) AS least, max(x) AS most FROM c GROUP BY ALL""", ("mean_abs", "least", "most"))
def _(spark, d):
    return sc.single_role_contrasts(dm.tuple_scores(spark, d))


def _inter(r1, r2, f):
    return f"""SELECT a.task, a.allocation, a.depth, a.model, '{r1}*{r2}' AS roles, (a.mse - b.mse) - (c.mse - e.mse) AS x FROM tuples a JOIN tuples b USING (task, allocation, depth, model, {f}, {r1})
 JOIN tuples c ON c.task = a.task AND c.allocation = a.allocation AND c.depth = a.depth AND c.model = a.model AND c.{f} = a.{f} AND c.{r2} = a.{r2} AND c.{r1} <> a.{r1}
 JOIN tuples e ON e.task = a.task AND e.allocation = a.allocation AND e.depth = a.depth AND e.model = a.model AND e.{f} = a.{f} AND e.{r2} = b.{r2} AND e.{r1} = c.{r1} WHERE a.{r2} <> b.{r2}"""


@query("role_interactions", R + ", c AS (" + " UNION ALL ".join(_inter(*x) for x in (("observation", "prediction", "input"), ("observation", "input", "prediction"), ("prediction", "input", "observation"))) + """)
SELECT task, allocation, depth, model, roles, count(*) AS n, avg(abs(x)) AS mean_abs FROM c GROUP BY ALL""", ("mean_abs",))
def _(spark, d):
    return sc.role_interactions(dm.tuple_scores(spark, d))


#: States of each model by input block, and the cross moments of residuals and block shifts.
_MOMENTS = """, st AS (SELECT task, gene, b.allocation, b.depth, b.block AS input, model, false AS conditioned, p FROM lpred JOIN lblocks b USING (gene) WHERE kind = 'state' UNION ALL SELECT task, gene, allocation, depth, input, model, true, p FROM lcond WHERE kind = 'state'),
km AS (SELECT task, allocation, depth, model, conditioned, avg(x) AS k FROM (SELECT st.task, st.allocation, st.depth, st.model, st.conditioned, st.input, bj.block, avg((st.p - y) * (bi.value - bj.value) / (s * s)) AS x FROM st JOIN ltargets USING (task, gene) JOIN lcontrol USING (gene)
  JOIN lblocks bi ON bi.gene = st.gene AND bi.allocation = st.allocation AND bi.depth = st.depth AND bi.block = st.input JOIN lblocks bj ON bj.gene = st.gene AND bj.allocation = st.allocation AND bj.depth = st.depth AND bj.block <> st.input GROUP BY ALL) GROUP BY ALL)
"""


@query("pattern_identities", R + """, wide AS (SELECT task, allocation, depth, model, kind, conditioned, max(mse) FILTER (pattern = 'S') AS s, max(mse) FILTER (pattern = 'M') AS m, max(mse) FILTER (pattern = 'P') AS p, max(mse) FILTER (pattern = 'O') AS o, max(mse) FILTER (pattern = 'D') AS d FROM patterns GROUP BY ALL)
""" + _MOMENTS + """, x AS (SELECT wide.*, v, k, max(d - s) FILTER (kind = 'state') OVER g - min(d - s) FILTER (kind = 'state') OVER g AS pair FROM wide JOIN vdist USING (allocation, depth) LEFT JOIN km USING (task, allocation, depth, model, conditioned) WINDOW g AS (PARTITION BY task, allocation, depth))
SELECT kind, conditioned, count(*) AS n, max(abs(m - s)) FILTER (kind = 'state') AS m_minus_s, max(abs(d - s - v)) FILTER (kind = 'state') AS d_minus_s_v, max(abs(p - s - v - 2 * k)) FILTER (kind = 'state') AS p_minus_s_v_2k, max(abs(o - s - v + 2 * k)) FILTER (kind = 'state') AS o_minus_s_v_2k,
max(abs(d - (p + o) / 2)) FILTER (kind = 'state') AS d_minus_po, max(greatest(s, m, p, o, d) - least(s, m, p, o, d)) FILTER (kind = 'effect' AND NOT conditioned) AS spread, max(pair) FILTER (kind = 'state') AS pair_shift, avg(CASE WHEN kind = 'state' THEN d - s - v ELSE d - s END) AS mean_shift FROM x GROUP BY ALL""",
       ("m_minus_s", "d_minus_s_v", "p_minus_s_v_2k", "o_minus_s_v_2k", "d_minus_po", "spread", "pair_shift", "mean_shift"))
def _(spark, d):
    return sc.pattern_identities(_patterns(spark, d), _distance(spark, d), _moments(spark, d))


def _moments(spark, d):
    blocks, predictions = dm.kept(dm.blocks(spark, d), "blocks"), dm.kept(dm.predictions(spark, d), "predictions")
    train = predictions.where("model = 'train_state'").select("task", F.col("prediction").alias("t"))
    states = sc.states_by_input(blocks, predictions, dm.conditioned(train, blocks))
    return sc.cross_moments(states, dm.targets(spark, d), blocks, dm.scales(spark, d))


@query("conditioning_displacement", R + _MOMENTS + """, dp AS (SELECT a.task, a.allocation, a.depth, a.model, a.conditioned, a.input, b.input AS other, avg(pow((a.p - b.p) / s, 2)) AS x FROM st a JOIN st b USING (task, allocation, depth, model, conditioned, gene) JOIN lcontrol USING (gene) WHERE a.input <> b.input GROUP BY ALL)
SELECT task, allocation, depth, model, conditioned, k, sqrt(avg(x)) AS displacement FROM dp JOIN km USING (task, allocation, depth, model, conditioned) GROUP BY ALL""", ("k", "displacement"))
def _(spark, d):
    return _moments(spark, d)


@query("operation_scores", R + """, ops(operation, input, prediction, observation) AS (VALUES ('anchor_O', 'B1', 'B1', 'B2'), ('input_only', 'B3', 'B1', 'B2'), ('rescore_only', 'B1', 'B1', 'B3'), ('matched_O_new_input', 'B3', 'B3', 'B2'), ('shared_S', 'B1', 'B1', 'B1')),
g AS (SELECT task, allocation, depth, model, operation, mse FROM tuples JOIN ops USING (input, prediction, observation)) SELECT g.*, g.mse - a.mse AS change FROM g JOIN g a USING (task, allocation, depth, model) WHERE a.operation = 'anchor_O'""", ("mse", "change"))
def _(spark, d):
    return sc.operation_scores(dm.tuple_scores(spark, d))


_RANGE = "SELECT depth, model, pattern, avg(x) AS mean, min(x) AS least, max(x) AS most FROM (SELECT allocation, depth, model, pattern, avg(mse) AS x FROM patterns GROUP BY ALL) GROUP BY ALL"


@query("allocation_range", R + _RANGE, ("mean", "least", "most"))
def _(spark, d):
    x = _patterns(spark, d).groupBy("allocation", "depth", "model", "pattern").agg(F.avg("mse").alias("x"))
    return x.groupBy("depth", "model", "pattern").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))


_ROOT = ", h AS (SELECT depth, task, model, target, avg(mse) AS mse FROM prim GROUP BY ALL), o AS (SELECT depth, model, target, avg(mse) AS mse FROM h GROUP BY ALL)\n"


@query("hierarchy_mean", R + _PRIMARY + _ROOT + "SELECT * FROM o", ("mse",))
def _(spark, d):
    return cm.chained_mean(sc.primary_scores(dm.tuple_scores(spark, d)), ["allocation", "task"], ["depth", "model", "target"], "mse")


_MARG = ", mg AS (SELECT a.task, a.allocation, a.depth, a.pattern, a.model AS model_a, b.model AS model_b, b.mse - a.mse AS margin FROM patterns a JOIN patterns b ON a.task = b.task AND a.allocation = b.allocation AND a.depth = b.depth AND a.pattern = b.pattern AND a.model < b.model)\n"


def _margins(spark, d):
    return cm.margins(_patterns(spark, d), ["task", "allocation", "depth", "pattern"], "model", "mse")


@query("strict_crossing", R + _MARG + """SELECT a.task, a.allocation, a.depth, a.pattern, a.model_a, a.model_b, sign(s.margin) <> sign(a.margin) AND abs(s.margin) > 1e-12 AND abs(a.margin) > 1e-12 AS crossed
FROM mg a JOIN mg s USING (task, allocation, depth, model_a, model_b) WHERE s.pattern = 'S' AND a.pattern <> 'S'""")
def _(spark, d):
    key = ["task", "allocation", "depth", "model_a", "model_b"]
    return cm.strict_crossing(cm.against_base(_margins(spark, d), key, "pattern", "S", "margin")).select(*key, "pattern", "crossed")


@query("crossing_counts", R + _MARG + """SELECT a.allocation, a.depth, a.pattern, count(*) FILTER (sign(s.margin) <> sign(a.margin) AND abs(s.margin) > 1e-12 AND abs(a.margin) > 1e-12) AS crossings, count(*) AS pairs
FROM mg a JOIN mg s USING (task, allocation, depth, model_a, model_b) WHERE s.pattern = 'S' AND a.pattern <> 'S' GROUP BY ALL""")
def _(spark, d):
    key = ["task", "allocation", "depth", "model_a", "model_b"]
    c = cm.strict_crossing(cm.against_base(_margins(spark, d), key, "pattern", "S", "margin"))
    return c.groupBy("allocation", "depth", "pattern").agg(F.count_if("crossed").alias("crossings"), F.count("*").alias("pairs"))


@query("pattern_displacement", R + """SELECT a.model, a.depth, a.pattern, sqrt(avg(pow(a.mse - s.mse, 2))) AS rms_change, avg(a.mse - s.mse) AS mean_change FROM patterns a JOIN patterns s USING (task, allocation, depth, model)
WHERE s.pattern = 'S' AND a.pattern <> 'S' GROUP BY ALL""", ("rms_change", "mean_change"))
def _(spark, d):
    c = cm.against_base(_patterns(spark, d).drop("tuples", "kind", "conditioned"), ["task", "allocation", "depth", "model"], "pattern", "S", "mse")
    change = F.col("after") - F.col("before")
    return c.groupBy("model", "depth", "pattern").agg(F.sqrt(F.avg(change * change)).alias("rms_change"), F.avg(change).alias("mean_change"))
