"""Queries: hierarchies, margins, ranks and selections over score and utility tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contraspark.operators import comparison as cm
from contraspark.plans import domain as dm
from contraspark.plans.domain import with_
from contraspark.plans.registry import query

S, U = with_("scores"), with_("util")
_UNIT = ", su AS (SELECT unit, budget, model, avg(c) AS score FROM (SELECT case_id, unit, budget, model, avg(score) AS c FROM scores GROUP BY ALL) GROUP BY ALL)\n"


def _unit_means(spark, d):
    return cm.chained_mean(dm.scores(spark, d), ["realization", "case_id"], ["unit", "budget", "model"], "score")


@query("seed_then_unit_mean", S + _UNIT + "SELECT budget, model, avg(score) AS score FROM su GROUP BY ALL", ("score",))
def _(spark, d):
    return cm.chained_mean(dm.scores(spark, d), ["realization", "case_id", "unit"], ["budget", "model"], "score")


@query("scheme_aggregate", S + "SELECT unit, budget, model, avg(t) AS score FROM (SELECT unit, budget, model, realization, avg(score) AS t FROM scores GROUP BY ALL) GROUP BY ALL", ("score",))
def _(spark, d):
    return cm.chained_mean(dm.scores(spark, d), ["case_id", "realization"], ["unit", "budget", "model"], "score")


@query("midrank", S + "SELECT case_id, budget, realization, model, rank() OVER (PARTITION BY case_id, budget, realization ORDER BY score DESC) + (count(*) OVER (PARTITION BY case_id, budget, realization, score) - 1) / 2.0::DOUBLE AS midrank FROM scores", ("midrank",))
def _(spark, d):
    return cm.midrank(dm.scores(spark, d), ["case_id", "budget", "realization"], "score").select("case_id", "budget", "realization", "model", "midrank")


_M = ", mg AS (SELECT a.case_id, a.unit, a.budget, a.realization, a.model AS model_a, b.model AS model_b, b.score - a.score AS margin FROM scores a JOIN scores b ON a.case_id = b.case_id AND a.unit = b.unit AND a.budget = b.budget AND a.realization = b.realization AND a.model < b.model)\n"


def _margins(spark, d):
    return cm.margins(dm.scores(spark, d), ["case_id", "unit", "budget", "realization"], "model", "score")


_TR = "CASE WHEN s.margin = 0 AND a.margin = 0 THEN 'tie_both' WHEN s.margin = 0 OR a.margin = 0 THEN 'tie_transition' WHEN sign(s.margin) <> sign(a.margin) THEN 'reversal' ELSE 'stable_order' END"


@query("reversal_vs_shared", S + _M + f"SELECT a.budget, {_TR} AS transition, count(*) AS n, sqrt(avg(pow(a.margin - s.margin, 2))) AS rms_change FROM mg a JOIN mg s USING (case_id, unit, realization, model_a, model_b) WHERE s.budget = 'A' AND a.budget <> 'A' GROUP BY ALL", ("rms_change",))
def _(spark, d):
    t = cm.transitions(cm.against_base(_margins(spark, d), ["case_id", "unit", "realization", "model_a", "model_b"], "budget", "A", "margin"), "before", "after")
    change = F.col("after") - F.col("before")
    return t.groupBy("budget", "transition").agg(F.count("*").alias("n"), F.sqrt(F.avg(change * change)).alias("rms_change"))


@query("allocation_direction_counts", S + _M + "SELECT case_id, budget, model_a, model_b, count(*) FILTER (margin > 0) AS favour_a, count(*) FILTER (margin < 0) AS favour_b, count(*) FILTER (margin = 0) AS ties, stddev_samp(margin) / sqrt(count(*)) AS standard_error FROM mg GROUP BY ALL", ("standard_error",))
def _(spark, d):
    m = F.col("margin")
    return _margins(spark, d).groupBy("case_id", "budget", "model_a", "model_b").agg(F.count_if(m > 0).alias("favour_a"), F.count_if(m < 0).alias("favour_b"), F.count_if(m == 0).alias("ties"), (F.stddev_samp(m) / F.sqrt(F.count("*"))).alias("standard_error"))


@query("complement_pair_mean", S + "SELECT case_id, budget, model, avg(x) AS score FROM (SELECT case_id, budget, model, realization::INT // 2 AS p, avg(score) AS x FROM scores GROUP BY ALL) GROUP BY ALL", ("score",))
def _(spark, d):
    return cm.chained_mean(dm.scores(spark, d).withColumn("p", F.floor(F.col("realization").cast("int") / 2)), ["realization", "p"], ["case_id", "budget", "model"], "score")


@query("paired_changes", S + _UNIT + """, mu AS (SELECT a.unit, a.budget, a.model AS model_a, b.model AS model_b, b.score - a.score AS margin FROM su a JOIN su b ON a.unit = b.unit AND a.budget = b.budget AND a.model < b.model)
SELECT a.unit, a.budget, a.model_a, a.model_b, a.margin - s.margin AS change FROM mu a JOIN mu s USING (unit, model_a, model_b) WHERE s.budget = 'A' AND a.budget <> 'A'""", ("change",))
def _(spark, d):
    c = cm.against_base(cm.margins(_unit_means(spark, d), ["unit", "budget"], "model", "score"), ["unit", "model_a", "model_b"], "budget", "A", "margin")
    return c.select("unit", "budget", "model_a", "model_b", (F.col("after") - F.col("before")).alias("change"))


@query("cartesian_seed_contrasts", S + """SELECT a.case_id, a.budget, avg(b.score - a.score) AS mean, min(b.score - a.score) AS least, max(b.score - a.score) AS most, count(*) AS n, count(*) FILTER (b.score > a.score) AS favour_a
FROM scores a JOIN scores b ON a.case_id = b.case_id AND a.budget = b.budget AND a.model = 'BUILDING' AND b.model = 'MACHINERY' GROUP BY ALL""", ("mean", "least", "most"))
def _(spark, d):
    s = dm.scores(spark, d)
    a, b = s.where("model = 'BUILDING'").alias("a"), s.where("model = 'MACHINERY'").alias("b")
    x = F.col("b.score") - F.col("a.score")
    j = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.budget") == F.col("b.budget")))
    return j.groupBy("a.case_id", "a.budget").agg(F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.count("*").alias("n"), F.count_if(x > 0).alias("favour_a"))


@query("focal_pattern_pass", S + _M + """, p AS (SELECT realization, avg(margin) FILTER (budget = 'A') AS shared, avg(margin) FILTER (budget = 'N') AS split, avg(margin) FILTER (budget = 'R') AS rotation FROM mg WHERE model_a = 'BUILDING' AND model_b = 'MACHINERY' GROUP BY realization)
SELECT *, shared < 0 AND split > 0 AND rotation > 0 AND split - shared > 0 AND rotation - shared > 0 AS passed FROM p""", ("shared", "split", "rotation"))
def _(spark, d):
    at = lambda b: F.avg(F.when(F.col("budget") == b, F.col("margin")))
    p = _margins(spark, d).where("model_a = 'BUILDING' and model_b = 'MACHINERY'").groupBy("realization").agg(at("A").alias("shared"), at("N").alias("split"), at("R").alias("rotation"))
    return p.withColumn("passed", F.expr("shared < 0 and split > 0 and rotation > 0 and split - shared > 0 and rotation - shared > 0"))


@query("leave_one_out_means", S + _UNIT + "SELECT unit, budget, model, (sum(score) OVER w - score) / (count(*) OVER w - 1) AS others_mean FROM su WINDOW w AS (PARTITION BY budget, model)", ("others_mean",))
def _(spark, d):
    return cm.leave_one_out(_unit_means(spark, d), ["budget", "model"], "score").drop("score")


@query("interaction_endpoints", S + """, e AS (SELECT case_id, unit, realization, max(score) FILTER (model = 'BUILDING' AND budget = 'A') AS s00, max(score) FILTER (model = 'BUILDING' AND budget = 'R') AS s01, max(score) FILTER (model = 'MACHINERY' AND budget = 'A') AS s10, max(score) FILTER (model = 'MACHINERY' AND budget = 'R') AS s11 FROM scores GROUP BY ALL),
c AS (SELECT unit, case_id, avg(s11 - s10 - s01 + s00) AS e1, avg(s11 - s01) AS e2, avg(s10 - s00) AS e3, avg(s01 - s00) AS e4 FROM e GROUP BY ALL) SELECT unit, avg(e1) AS e1, avg(e2) AS e2, avg(e3) AS e3, avg(e4) AS e4 FROM c GROUP BY unit""", ("e1", "e2", "e3", "e4"))
def _(spark, d):
    at = lambda m, b: F.max(F.when((F.col("model") == m) & (F.col("budget") == b), F.col("score")))
    e = dm.scores(spark, d).groupBy("case_id", "unit", "realization").agg(at("BUILDING", "A").alias("s00"), at("BUILDING", "R").alias("s01"), at("MACHINERY", "A").alias("s10"), at("MACHINERY", "R").alias("s11"))
    names = {"e1": "s11 - s10 - s01 + s00", "e2": "s11 - s01", "e3": "s10 - s00", "e4": "s01 - s00"}
    c = e.groupBy("unit", "case_id").agg(*[F.avg(F.expr(x)).alias(n) for n, x in names.items()])
    return c.groupBy("unit").agg(*[F.avg(n).alias(n) for n in names])


@query("midpoint_identity", S + """, m AS (SELECT case_id, realization, model, max(score) FILTER (budget = 'A') AS a, max(score) FILTER (budget = 'R') AS b, (max(score) FILTER (budget = 'A') + max(score) FILTER (budget = 'R')) / 2 AS c FROM scores GROUP BY ALL)
SELECT case_id, realization, model, c - (a + b) / 2 AS residual FROM m""", ("residual",))
def _(spark, d):
    at = lambda b: F.max(F.when(F.col("budget") == b, F.col("score")))
    m = dm.scores(spark, d).groupBy("case_id", "realization", "model").agg(at("A").alias("a"), at("R").alias("b"))
    return m.withColumn("c", F.expr("(a + b) / 2")).select("case_id", "realization", "model", F.expr("c - (a + b) / 2").alias("residual"))


@query("balanced_batch_mean", S + "SELECT budget, model, avg(b) AS score, count(*) AS batches, min(o) AS orientations FROM (SELECT unit, budget, model, avg(x) AS b, count(*) AS o FROM (SELECT unit, budget, model, realization::INT % 2 AS r, avg(score) AS x FROM scores GROUP BY ALL) GROUP BY ALL) GROUP BY ALL", ("score",))
def _(spark, d):
    x = dm.scores(spark, d).groupBy("unit", "budget", "model", F.expr("int(realization) % 2").alias("r")).agg(F.avg("score").alias("x"))
    b = x.groupBy("unit", "budget", "model").agg(F.avg("x").alias("b"), F.count("*").alias("o"))
    return b.groupBy("budget", "model").agg(F.avg("b").alias("score"), F.count("*").alias("batches"), F.min("o").alias("orientations"))


@query("rms_of_seed_rms", S + "SELECT case_id, budget, sqrt(avg(pow(r, 2))) AS rms FROM (SELECT case_id, budget, realization, sqrt(avg(score * score)) AS r FROM scores GROUP BY ALL) GROUP BY ALL", ("rms",))
def _(spark, d):
    r = dm.scores(spark, d).groupBy("case_id", "budget", "realization").agg(F.sqrt(F.avg(F.col("score") * F.col("score"))).alias("r"))
    return r.groupBy("case_id", "budget").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"))


@query("metric_concordance", S + """, x AS (SELECT case_id, budget, model, avg(score) FILTER (realization::INT % 2 = 0) AS u, floor(avg(score) FILTER (realization::INT % 2 = 1)) AS v FROM scores GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY case_id, budget ORDER BY u) AS ur, count(*) OVER (PARTITION BY case_id, budget, u) AS un, rank() OVER (PARTITION BY case_id, budget ORDER BY v) AS vr, count(*) OVER (PARTITION BY case_id, budget, v) AS vn FROM x),
t AS (SELECT a.case_id, a.budget, sum(sign(a.u - b.u) * sign(a.v - b.v)) AS s, sum(abs(sign(a.u - b.u))) AS nu, sum(abs(sign(a.v - b.v))) AS nv FROM x a JOIN x b ON a.case_id = b.case_id AND a.budget = b.budget AND a.model < b.model GROUP BY ALL),
g AS (SELECT case_id, budget, bool_and(ur = vr AND un = vn) AS ranks_identical, bool_and((ur = 1) = (vr = 1)) AS leader_sets_identical FROM k GROUP BY ALL)
SELECT case_id, budget, CASE WHEN nu > 0 AND nv > 0 THEN s / sqrt(nu * nv) END AS tau_b, ranks_identical, leader_sets_identical, CASE WHEN nu > 0 AND nv > 0 THEN 'defined' ELSE 'constant_metric' END AS status FROM g JOIN t USING (case_id, budget)""", ("tau_b",))
def _(spark, d):
    """Mean losses of even realizations against those of odd ones in whole units, which tie."""
    odd = F.expr("int(realization) % 2")
    x = dm.scores(spark, d).groupBy("case_id", "budget", "model").agg(F.avg(F.when(odd == 0, F.col("score"))).alias("u"), F.floor(F.avg(F.when(odd == 1, F.col("score")))).cast("double").alias("v"))
    return cm.metric_concordance(x, ["case_id", "budget"], "model", "u", "v")


#: The declared order of families.
_ORDER = ["MACHINERY", "AUTOMOBILE", "HOUSEHOLD", "BUILDING", "FURNITURE"]


@query("winner_selection", S + """, p AS (SELECT budget, case_id AS held_out, model, avg(score) AS v FROM scores GROUP BY ALL), t AS (SELECT budget, model, sum(v) AS s, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT budget, held_out, model, (s - v) / (n - 1) AS m FROM p JOIN t USING (budget, model) WHERE n > 1 UNION ALL SELECT budget, NULL, model, s / n FROM t),
o(model, place) AS (VALUES ('MACHINERY', 1), ('AUTOMOBILE', 2), ('HOUSEHOLD', 3), ('BUILDING', 4), ('FURNITURE', 5)),
b AS (SELECT *, m - min(m) OVER (PARTITION BY budget, held_out) AS gap FROM m LEFT JOIN o USING (model)), c AS (SELECT *, row_number() OVER (PARTITION BY budget, held_out ORDER BY gap, place) AS nth FROM b),
w AS (SELECT budget, held_out, arg_min(model, place) FILTER (gap <= 1e-12) AS winner, count(*) FILTER (gap <= 1e-12) AS tied, min(gap) FILTER (nth = 2) AS second_gap, min(gap) FILTER (gap > 1e-12) AS outside_gap FROM c GROUP BY ALL),
s AS (SELECT w.*, w.winner = a.winner AS same FROM w JOIN w a ON w.budget = a.budget AND a.held_out IS NULL)
SELECT *, avg(same::INT) FILTER (held_out IS NOT NULL) OVER (PARTITION BY budget) AS stability FROM s""", ("second_gap", "outside_gap", "stability"))
def _(spark, d):
    """The family of least mean loss over all nations and without each of them."""
    return cm.winner_stability(dm.scores(spark, d), ["budget"], "case_id", "model", "score", _ORDER)


@query("grid_selection", S + """, g AS (SELECT budget, model, realization, avg(score) AS score FROM scores GROUP BY ALL), n AS (SELECT *, min(score) OVER (PARTITION BY budget) AS best FROM g)
SELECT budget, model, realization, score FROM n WHERE score <= best + 0.5 QUALIFY row_number() OVER (PARTITION BY budget ORDER BY realization DESC, model) = 1""", ("score",))
def _(spark, d):
    g = dm.scores(spark, d).groupBy("budget", "model", "realization").agg(F.avg("score").alias("score"))
    w = Window.partitionBy("budget")
    near = g.withColumn("best", F.min("score").over(w)).where(F.col("score") <= F.col("best") + 0.5)
    return near.withColumn("nth", F.row_number().over(w.orderBy(F.desc("realization"), "model"))).where("nth = 1").select("budget", "model", "realization", "score")


@query("official_score_pairs", S + _M + """SELECT a.case_id, a.budget, a.realization, a.model_a, a.model_b, CASE WHEN abs(a.margin) <= 1e-12 THEN 0 ELSE sign(a.margin)::INT END AS direction, CASE WHEN abs(s.margin) <= 1e-12 THEN 0 ELSE sign(s.margin)::INT END AS original
FROM mg a LEFT JOIN (SELECT * FROM mg WHERE realization = '1' AND budget <> 'N') s USING (case_id, budget, model_a, model_b)""")
def _(spark, d):
    m = _margins(spark, d)
    sign = lambda c: F.when(F.abs(c) <= 1e-12, 0).otherwise(F.signum(c).cast("int"))
    key = ["case_id", "budget", "model_a", "model_b"]
    s = m.where("realization = '1' and budget <> 'N'").select(*key, F.col("margin").alias("m1"))
    j = m.join(s, key, "left")
    return j.select(*key, "realization", sign("margin").alias("direction"), F.when(F.col("m1").isNotNull(), sign("m1")).alias("original"))


@query("worker_completeness", S + """, e AS (SELECT * FROM (SELECT DISTINCT case_id FROM scores), (SELECT DISTINCT budget FROM scores), (SELECT DISTINCT model FROM scores))
SELECT e.*, score, CASE WHEN score IS NULL THEN 'missing' ELSE 'done' END AS status FROM e LEFT JOIN (SELECT case_id, budget, model, score FROM scores WHERE realization = '2' AND score > 24) s USING (case_id, budget, model)""", ("score",))
def _(spark, d):
    s = dm.scores(spark, d)
    jobs = s.select("case_id").distinct().crossJoin(F.broadcast(s.select("budget").distinct())).crossJoin(F.broadcast(s.select("model").distinct()))  # small rosters
    done = s.where("realization = '2' and score > 24").select("case_id", "budget", "model", "score")
    return jobs.join(done, ["case_id", "budget", "model"], "left").withColumn("status", F.when(F.col("score").isNull(), "missing").otherwise("done"))


@query("weighted_policy_summary", S + """, x AS (SELECT *, case_id::DOUBLE + 1 AS wt FROM scores), m AS (SELECT model, budget, sum(score * wt) / sum(wt) AS mean FROM x GROUP BY ALL)
SELECT m.model, m.budget, m.mean, CASE WHEN b.mean <> 0 THEN 1 - m.mean / b.mean END AS reduction FROM m JOIN m b USING (model) WHERE b.budget = 'A'""", ("mean", "reduction"))
def _(spark, d):
    return cm.weighted_summary(dm.scores(spark, d).withColumn("wt", F.col("case_id").cast("double") + 1), ["model"], "budget", "A", "score", "wt")


@query("claim_mapping", S + _M + """, f AS (SELECT case_id, model_a, model_b, bool_and(margin > 0) FILTER (budget = 'A') AS r, bool_and(margin > 0) FILTER (budget = 'R') AS c FROM mg GROUP BY ALL)
SELECT case_id, model_a, model_b, CASE WHEN r IS NULL OR c IS NULL THEN 'incomplete' WHEN r AND c THEN 'joint' WHEN r THEN 'representation' WHEN c THEN 'conditioning' ELSE 'none' END AS claim FROM f""")
def _(spark, d):
    at = lambda b: F.bool_and(F.when(F.col("budget") == b, F.col("margin") > 0))
    f = _margins(spark, d).groupBy("case_id", "model_a", "model_b").agg(at("A").alias("r"), at("R").alias("c"))
    claim = F.expr("case when r is null or c is null then 'incomplete' when r and c then 'joint' when r then 'representation' when c then 'conditioning' else 'none' end")
    return f.select("case_id", "model_a", "model_b", claim.alias("claim"))


@query("family_eligibility", S + ", p AS (SELECT model, bool_and(abs(a - b) <= 3) AS agree, count(*) AS n FROM (SELECT case_id, budget, model, max(score) FILTER (realization = '1') AS a, max(score) FILTER (realization = '2') AS b FROM scores GROUP BY ALL) GROUP BY ALL) SELECT model, n, n = (SELECT count(DISTINCT case_id) * count(DISTINCT budget) FROM scores) AND agree AS go FROM p")
def _(spark, d):
    at = lambda r: F.max(F.when(F.col("realization") == r, F.col("score")))
    x = dm.scores(spark, d).groupBy("case_id", "budget", "model").agg(at("1").alias("a"), at("2").alias("b"))
    p = x.groupBy("model").agg(F.bool_and(F.abs(F.col("a") - F.col("b")) <= 3).alias("agree"), F.count("*").alias("n"))
    axes = F.broadcast(dm.scores(spark, d).agg((F.count_distinct("case_id") * F.count_distinct("budget")).alias("_cells")))  # one row
    return p.crossJoin(axes).select("model", "n", ((F.col("n") == F.col("_cells")) & F.col("agree")).alias("go"))


@query("paired_difference_summary", S + _M + """, e AS (SELECT model_a AS reference, model_b AS other, margin FROM mg UNION ALL SELECT model_b, model_a, -margin FROM mg)
SELECT reference, other, avg(margin) AS mean, count(*) FILTER (margin > 0) AS higher, count(*) FILTER (margin < 0) AS lower FROM e GROUP BY ALL""", ("mean",))
def _(spark, d):
    """Every model as the reference of every other."""
    m = _margins(spark, d)
    e = m.select(F.col("model_a").alias("reference"), F.col("model_b").alias("other"), "margin").union(m.select("model_b", "model_a", -F.col("margin")))
    return e.groupBy("reference", "other").agg(F.avg("margin").alias("mean"), F.count_if(F.col("margin") > 0).alias("higher"), F.count_if(F.col("margin") < 0).alias("lower"))


@query("quantile_summary_check", S + "SELECT budget, model, avg(score) AS mean, quantile_cont(score, 0.05) AS q05, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.95) AS q95, -quantile_cont(score, 0.95) AS oriented_q05 FROM scores GROUP BY ALL", ("mean", "q05", "q50", "q95", "oriented_q05"))
def _(spark, d):
    q = lambda p: F.percentile("score", p)
    return dm.scores(spark, d).groupBy("budget", "model").agg(F.avg("score").alias("mean"), q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95"), (-q(0.95)).alias("oriented_q05"))
