"""Queries: organizer policies, risk and coverage, reporting rules, unit-level inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contraspark.operators import comparison as cm
from contraspark.operators import inference as inf
from contraspark.operators import organizer as og
from contraspark.operators import paired as pr
from contraspark.operators import publication as pu
from contraspark.operators.prefix import numbered
from contraspark.plans import domain as dm
from contraspark.plans.domain import with_
from contraspark.plans.registry import query, table

GAP = 0.5
_MG = "{n} AS (SELECT a.case_id, a.unit, a.budget, a.realization, a.model AS model_a, b.model AS model_b, b.score - a.score AS margin FROM {t} a JOIN {t} b ON a.case_id = b.case_id AND a.unit = b.unit AND a.budget = b.budget AND a.realization = b.realization AND a.model < b.model)"
_BASE = with_("scores", "dev", "asm") + ", " + _MG.format(n="dmg", t="dev") + ", " + _MG.format(n="amg", t="asm") + """,
sh AS (SELECT m.case_id, m.unit, m.budget, m.model_a, m.model_b, max(a.margin) AS anchor, max(abs(m.margin - a.margin)) AS shift FROM dmg m JOIN dmg a USING (case_id, budget, model_a, model_b) WHERE a.realization = '1' GROUP BY ALL),
bd AS (SELECT budget, model_a, model_b, max(shift) AS bound FROM sh GROUP BY ALL),
geo AS (SELECT case_id, budget, CASE WHEN case_id::INT % 7 = 3 AND (budget = 'R' OR (budget = 'N' AND case_id::INT % 2 = 1)) THEN 0.0 ELSE max(score) - min(score) END::DOUBLE AS geometry FROM scores WHERE realization = '1' GROUP BY case_id, budget),
gf0 AS (SELECT budget, model_a, model_b, max(CASE WHEN geometry > 1e-12 THEN shift / geometry END) AS factor, count(*) FILTER (geometry <= 1e-12 AND shift > 1e-12) AS unexplained FROM sh JOIN geo USING (case_id, budget) GROUP BY ALL),
gf AS (SELECT budget, model_a, model_b, CASE WHEN unexplained = 0 THEN factor END AS factor, unexplained, CASE WHEN unexplained > 0 THEN 'development_zero_geometry_shift' WHEN factor IS NULL THEN 'no_positive_development_geometry' ELSE 'available' END AS reason FROM gf0),
dec0 AS (SELECT m.case_id, m.unit, budget, model_a, model_b, margin, unnest(['single_split', 'repeated_primary', 'geometry_scaled']) AS policy, unnest([0.0::DOUBLE, bound, CASE WHEN geometry > 1e-12 THEN factor * geometry END]) AS "limit",
 unnest([NULL, NULL, CASE WHEN gf.reason <> 'available' THEN gf.reason WHEN geometry <= 1e-12 THEN 'assessment_geometry_at_or_below_tolerance' END]) AS held FROM amg m JOIN bd USING (budget, model_a, model_b) JOIN gf USING (budget, model_a, model_b) JOIN geo USING (case_id, budget) WHERE m.realization = '1'),
dec AS (SELECT *, coalesce(abs(margin) > "limit" + 0.5 + 1e-12, false) AS released, CASE WHEN margin > 1e-12 THEN model_a WHEN margin < -1e-12 THEN model_b END AS favoured FROM dec0),
ass AS (SELECT d.case_id, d.unit, budget, model_a, model_b, policy, d.margin, d."limit", released, favoured, count(*) AS realizations, bool_and(sign(d.margin) * m.margin > 0.5 + 1e-12) AS supported, bool_or(sign(d.margin) * m.margin < -1e-12) AS reversal, bool_or(abs(m.margin * sign(d.margin)) <= 1e-12) AS tie,
 bool_or(sign(d.margin) * m.margin > 1e-12 AND sign(d.margin) * m.margin <= 0.5 + 1e-12) AS within_gap FROM dec d JOIN amg m USING (case_id, budget, model_a, model_b) GROUP BY ALL)
"""


def _geometry(spark, d):
    g = dm.scores(spark, d).where("realization = '1'").groupBy("case_id", "budget").agg((F.max("score") - F.min("score")).alias("geometry"))
    return g.withColumn("geometry", F.when(F.expr("int(case_id) % 7 = 3 and (budget = 'R' or (budget = 'N' and int(case_id) % 2 = 1))"), 0.0).otherwise(F.col("geometry")))


def _decided(spark, d):
    dev, geometry = dm.development(spark, d), _geometry(spark, d)
    factor = og.calibrate_geometry(dev, geometry)
    return og.release_decisions(dm.assessment(spark, d).where("realization = '1'"), og.calibrate_shift(dev), factor, geometry, GAP)


def _assessed(spark, d):
    return og.assess(_decided(spark, d), dm.assessment(spark, d), GAP)


@query("calibrate_shift", _BASE + "SELECT * FROM bd", ("bound",))
def _(spark, d):
    return og.calibrate_shift(dm.development(spark, d))


@query("calibrate_geometry", _BASE + "SELECT * FROM gf", ("factor",))
def _(spark, d):
    return og.calibrate_geometry(dm.development(spark, d), _geometry(spark, d))


@query("release_decisions", _BASE + """SELECT * EXCLUDE (held), CASE WHEN held IS NOT NULL THEN held WHEN released THEN 'margin_exceeds_range_and_gap' ELSE 'margin_within_range_or_gap' END AS reason FROM dec""", ("margin", '"limit"'))
def _(spark, d):
    return _decided(spark, d)


@query("assess_releases", _BASE + "SELECT * FROM ass", ("margin", '"limit"'))
def _(spark, d):
    return _assessed(spark, d)


_PS = """, ps AS (SELECT budget, policy, count(*) AS comparisons, count(*) FILTER (released) AS n_released, count(*) FILTER (released AND NOT supported) AS unsupported, count(*) FILTER (released AND reversal) AS reversals FROM ass GROUP BY ALL),
ps2 AS (SELECT *, n_released::DOUBLE / comparisons AS coverage, CASE WHEN n_released > 0 THEN unsupported::DOUBLE / n_released END AS unsupported_share FROM ps)\n"""


@query("policy_summary", _BASE + _PS + "SELECT * FROM ps2", ("coverage", "unsupported_share"))
def _(spark, d):
    return og.policy_summary(_assessed(spark, d))


_VERDICT = "CASE WHEN g.n_released = 0 THEN 'insufficient_releases' WHEN g.unsupported <= r.unsupported AND g.coverage >= r.coverage THEN CASE WHEN g.unsupported < r.unsupported OR g.coverage > r.coverage THEN 'strict_gain' ELSE 'parity' END ELSE 'no_gain' END AS verdict"


@query("policy_compare", _BASE + _PS + f"SELECT g.budget, {_VERDICT} FROM ps2 g JOIN ps2 r USING (budget) WHERE g.policy = 'geometry_scaled' AND r.policy = 'repeated_primary'")
def _(spark, d):
    return og.compare_policies(og.policy_summary(_assessed(spark, d)))


_REC = ", won AS (SELECT case_id, policy, budget, favoured, count(*) AS wins FROM dec WHERE released GROUP BY ALL HAVING count(*) = 4), rec AS (SELECT c.case_id, c.policy, min(budget) AS budget, arg_min(favoured, budget) AS winner FROM (SELECT DISTINCT case_id, policy FROM dec) c LEFT JOIN won w ON c.case_id = w.case_id AND c.policy = w.policy GROUP BY ALL)\n"


@query("budget_recommendation", _BASE + _REC + "SELECT * FROM rec")
def _(spark, d):
    return og.budget_recommendation(_decided(spark, d), 5, ["A", "N", "R"])


@query("budget_assessment", _BASE + _REC + "SELECT r.case_id, r.policy, r.budget, r.winner, bool_and(a.supported) AS supported FROM rec r JOIN ass a ON a.case_id = r.case_id AND a.policy = r.policy AND a.budget = r.budget AND (a.model_a = r.winner OR a.model_b = r.winner) GROUP BY ALL")
def _(spark, d):
    r = og.budget_recommendation(_decided(spark, d), 5, ["A", "N", "R"])
    j = r.join(_assessed(spark, d), ["case_id", "policy", "budget"]).where("model_a = winner or model_b = winner")
    return j.groupBy("case_id", "policy", "budget", "winner").agg(F.bool_and("supported").alias("supported"))


_DS = ", ds AS (SELECT budget, gap, greatest(gap, coalesce(max(abs(anchor)) FILTER (NOT ok), 0)) AS threshold FROM (SELECT m.case_id, m.budget, m.model_a, m.model_b, gap, any_value(s.anchor) AS anchor, bool_and(sign(s.anchor) * m.margin > gap) AS ok FROM dmg m JOIN sh s USING (case_id, budget, model_a, model_b), (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE]) AS gap) GROUP BY ALL) GROUP BY budget, gap)\n"


@query("development_margin_threshold", _BASE + _DS + "SELECT * FROM ds", ("gap", "threshold"))
def _(spark, d):
    dev = dm.development(spark, d)
    m = og.oriented(dev).join(og.shifts(dev).select("case_id", *og.PAIR, "anchor"), ["case_id", *og.PAIR]).withColumn("gap", F.explode(F.array(F.lit(0.0), F.lit(0.5))))
    g = m.groupBy("case_id", *og.PAIR, "gap").agg(F.max("anchor").alias("anchor"), F.bool_and(F.signum("anchor") * F.col("margin") > F.col("gap")).alias("ok"))
    return g.groupBy("budget", "gap").agg(F.max(F.when(~F.col("ok"), F.abs("anchor"))).alias("x")).select("budget", "gap", F.greatest("gap", F.coalesce("x", F.lit(0.0))).alias("threshold"))


_RULES = "(VALUES ('small', 1.0::DOUBLE), ('medium', 3.0::DOUBLE), ('large', 6.0::DOUBLE)) r(rule, least)"


@query("comparison_rules", _BASE + f"SELECT rule, case_id, budget, model_a, model_b FROM amg, {_RULES} WHERE realization = '1' AND abs(margin) > least")
def _(spark, d):
    rules = spark.createDataFrame([("small", 1.0), ("medium", 3.0), ("large", 6.0)], "rule string, least double")
    m = og.oriented(dm.assessment(spark, d).where("realization = '1'")).crossJoin(F.broadcast(rules))  # three rules
    return m.where(F.abs("margin") > F.col("least")).select("rule", "case_id", *og.PAIR)


_RC = """, one AS (SELECT * FROM ass WHERE policy = 'single_split'), rc AS (SELECT case_id, unit, budget, model_a, model_b, abs(margin) AS priority, NOT supported AS bad, reversal AS strict, row_number() OVER w AS k, row_number() OVER w / count(*) OVER (PARTITION BY budget)::DOUBLE AS coverage,
 sum((NOT supported)::INT) OVER (PARTITION BY budget ORDER BY abs(margin) DESC, case_id, model_a, model_b ROWS UNBOUNDED PRECEDING) / (row_number() OVER w)::DOUBLE AS risk,
 sum(reversal::INT) OVER (PARTITION BY budget ORDER BY abs(margin) DESC, case_id, model_a, model_b ROWS UNBOUNDED PRECEDING) / (row_number() OVER w)::DOUBLE AS strict_risk, count(*) OVER (PARTITION BY budget, abs(margin)) AS tied FROM one WINDOW w AS (PARTITION BY budget ORDER BY abs(margin) DESC, case_id, model_a, model_b))\n"""
_RCD = ("priority", "coverage", "risk", "strict_risk")


def _curve_rows(spark, d):
    a = dm.kept(_assessed(spark, d), "assessed").where("policy = 'single_split'")
    return a.select("case_id", "unit", *og.PAIR, F.abs("margin").alias("priority"), (~F.coalesce("supported", F.lit(False))).alias("bad"), F.coalesce("reversal", F.lit(False)).alias("strict"))


def _curve(spark, d):
    return og.risk_coverage(_curve_rows(spark, d), ["budget"], "priority", "bad", ["case_id", "model_a", "model_b"], "strict")


@query("risk_coverage_curve", _BASE + _RC + "SELECT * FROM rc", _RCD)
def _(spark, d):
    return _curve(spark, d)


@query("unit_macro_risk_curve", _BASE + _RC + """, ut AS (SELECT budget, unit, count(*) AS t FROM rc GROUP BY ALL), un AS (SELECT budget, count(*) AS nu FROM ut GROUP BY budget)
SELECT budget, k, avg(e) AS macro_risk, count(*) AS units, sum(n / t) / any_value(nu) AS macro_coverage FROM (SELECT a.budget, a.k, b.unit, avg(b.bad::INT) AS e, count(*) AS n FROM rc a JOIN rc b ON a.budget = b.budget AND b.k <= a.k GROUP BY ALL) JOIN ut USING (budget, unit) JOIN un USING (budget) GROUP BY budget, k""", ("macro_risk", "macro_coverage"))
def _(spark, d):
    c = og.unit_macro_curve(_curve_rows(spark, d), ["budget"], "unit", "priority", "bad", ["case_id", "model_a", "model_b"])
    return c.select("budget", "k", "macro_risk", "units", "macro_coverage")


@query("aurc", _BASE + _RC + "SELECT budget, avg(risk) AS aurc FROM rc GROUP BY budget", ("aurc",))
def _(spark, d):
    return _curve(spark, d).groupBy("budget").agg(F.avg("risk").alias("aurc"))


@query("coverage_grid", _BASE + _RC + "SELECT rc.budget, c, k, risk FROM rc JOIN (SELECT budget, count(*) AS n FROM rc GROUP BY budget) USING (budget), (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 1.0]) AS c) WHERE k = ceil(c * n)", ("c", "risk"))
def _(spark, d):
    grid = spark.createDataFrame([(x,) for x in (0.1, 0.25, 0.5, 1.0)], "c double")
    c = _curve(spark, d)
    n = c.groupBy("budget").agg(F.max("k").alias("n"))
    return c.crossJoin(F.broadcast(grid)).join(n, "budget").where(F.col("k") == F.ceil(F.col("c") * F.col("n"))).select("budget", "c", "k", "risk")  # four rows


@query("group_risk_summary", _BASE + _RC + "SELECT budget, unit, model_a, model_b, count(*) AS n, avg(bad::INT) AS risk FROM rc GROUP BY GROUPING SETS ((budget, unit), (budget, model_a, model_b))", ("risk",))
def _(spark, d):
    b = F.col("bad").cast("int")
    return _curve_rows(spark, d).groupingSets([["budget", "unit"], ["budget", "model_a", "model_b"]], "budget", "unit", "model_a", "model_b").agg(F.count("*").alias("n"), F.avg(b).alias("risk"))


@query("scores_from_protocol", with_("scores") + "SELECT CASE WHEN case_id::INT % 2 = 0 THEN 'development' WHEN realization = '1' THEN 'anchor' ELSE 'assessment' END AS part, budget AS depth, count(*) AS n FROM scores GROUP BY ALL")
def _(spark, d):
    part = F.expr("case when int(case_id) % 2 = 0 then 'development' when realization = '1' then 'anchor' else 'assessment' end")
    return dm.scores(spark, d).groupBy(part.alias("part"), F.col("budget").alias("depth")).agg(F.count("*").alias("n"))


@query("input_stage_split", with_("scores", "asm") + "SELECT * FROM asm WHERE realization = '1'", ("score",))
def _(spark, d):
    return dm.assessment(spark, d).where("realization = '1'")


# ---- unit-level inference ------------------------------------------------------------------------

U = with_("util") + """, nu AS (SELECT allocation_id, count(DISTINCT unit_id) AS units FROM util GROUP BY allocation_id),
s0 AS (SELECT a.dataset_id, a.allocation_id, a.method_id AS source, b.method_id AS target, count(*) FILTER (a.utility > b.utility) AS wins, count(*) FILTER (a.utility < b.utility) AS losses, count(*) FILTER (a.utility = b.utility) AS ties
 FROM util a JOIN util b ON a.allocation_id = b.allocation_id AND a.unit_id = b.unit_id AND a.method_id <> b.method_id GROUP BY ALL),
sc AS (SELECT s0.*, units - wins - losses - ties AS missing FROM s0 JOIN nu USING (allocation_id)),
tl AS (SELECT sc.*, (wins + losses)::INT AS k, CASE WHEN missing = 0 THEN 1 END * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM (SELECT unnest(range(wins, wins + losses + 1)) AS i, wins + losses AS n)) AS p FROM sc),
hr AS (SELECT *, row_number() OVER (PARTITION BY allocation_id ORDER BY round(coalesce(p, 1), 10), source, target) AS holm_rank, count(*) OVER (PARTITION BY allocation_id) AS m FROM tl),
hm AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, max(coalesce(p, 1) * (m - holm_rank + 1)) OVER (PARTITION BY allocation_id ORDER BY holm_rank ROWS UNBOUNDED PRECEDING)) END AS adjusted FROM hr)
"""


def _tails(spark, d):
    return inf.sign_tails(inf.sign_counts(dm.utilities(spark, d)))


def _holm(spark, d):
    t = _tails(spark, d).withColumn("pr", F.round("p", 10))
    return inf.holm(t.withColumn("p", F.col("pr")), ["allocation_id"], "p", ["source", "target"]).drop("pr")


@query("sign_counts", U + "SELECT * FROM sc")
def _(spark, d):
    return inf.sign_counts(dm.utilities(spark, d))


@query("exact_sign_tail", U + "SELECT source, target, allocation_id, wins, k, p FROM tl", ("p",))
def _(spark, d):
    return _tails(spark, d).select("source", "target", "allocation_id", "wins", "k", "p")


@query("holm_adjust", U + "SELECT allocation_id, source, target, round(adjusted, 6) AS adjusted FROM hm", ("adjusted",))
def _(spark, d):
    return _holm(spark, d).select("allocation_id", "source", "target", F.round("adjusted", 6).alias("adjusted"))


@query("bonferroni_adjust", U + "SELECT allocation_id, source, target, least(1.0, p * m) AS adjusted FROM hr", ("adjusted",))
def _(spark, d):
    return _tails(spark, d).select("allocation_id", "source", "target", F.least(F.lit(1.0), F.col("p") * F.count("*").over(Window.partitionBy("allocation_id"))).alias("adjusted"))


@query("k_min_attainability", U + "SELECT allocation_id, count(*) AS m, ceil(log2(count(*) / 0.05) - 1e-12)::INT AS least_k FROM sc GROUP BY allocation_id")
def _(spark, d):
    return inf.sign_counts(dm.utilities(spark, d)).groupBy("allocation_id").agg(F.count("*").alias("m")).withColumn("least_k", inf.smallest_k(F.col("m"), 0.05))


@query("directional_decisions", U + "SELECT allocation_id, source, target, k, CASE WHEN adjusted IS NULL OR k < least_k THEN 'WITHHELD' WHEN adjusted <= 0.05 THEN 'DIRECTION' ELSE 'NO_DIRECTION' END AS decision, CASE WHEN adjusted IS NULL THEN 'missing_units' WHEN k < least_k THEN 'too_few_untied_units' END AS reason FROM (SELECT *, ceil(log2(m / 0.05) - 1e-12) AS least_k FROM hm)")
def _(spark, d):
    return inf.directional(_holm(spark, d), 0.05, ["allocation_id"]).select("allocation_id", "source", "target", "k", "decision", "reason")


_US = ", us AS (SELECT allocation_id, method_id, avg(utility) AS mean, median(utility) AS median, min(utility) AS least, max(utility) AS most FROM util GROUP BY ALL)\n"


@query("unit_summaries", with_("util") + _US + "SELECT *, rank() OVER (PARTITION BY allocation_id ORDER BY round(mean, 9) DESC) AS rank FROM us", ("mean", "median", "least", "most"))
def _(spark, d):
    u = F.col("utility")
    s = dm.utilities(spark, d).groupBy("allocation_id", "method_id").agg(F.avg(u).alias("mean"), F.percentile(u, 0.5).alias("median"), F.min(u).alias("least"), F.max(u).alias("most"))
    return s.withColumn("rank", F.rank().over(Window.partitionBy("allocation_id").orderBy(F.desc(F.round("mean", 9)))))


@query("complete_ordered_plan", with_("util") + ", m AS (SELECT DISTINCT method_id FROM util), a AS (SELECT DISTINCT allocation_id FROM util) SELECT allocation_id, x.method_id AS source, y.method_id AS target, row_number() OVER (ORDER BY allocation_id, x.method_id, y.method_id) AS ordinal FROM a, m x, m y WHERE x.method_id <> y.method_id")
def _(spark, d):
    u = dm.utilities(spark, d)
    m = u.select("method_id").distinct()
    p = u.select("allocation_id").distinct().crossJoin(F.broadcast(m.withColumnRenamed("method_id", "source"))).crossJoin(F.broadcast(m.withColumnRenamed("method_id", "target"))).where("source <> target")  # rosters
    return numbered(p, ["allocation_id", "source", "target"], "ordinal", start=1)


@query("unit_audit_geometry", "SELECT s_nationkey AS unit, count(*) AS objects, min(s_suppkey) AS first_object, (SELECT count(DISTINCT t.s_nationkey) FROM supplier s JOIN supplier t ON round(s.s_acctbal / 100) = round(t.s_acctbal / 100) AND s.s_nationkey <> t.s_nationkey WHERE s.s_nationkey = u.s_nationkey) AS neighbours FROM supplier u GROUP BY s_nationkey")
def unit_geometry(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") / 100).alias("v"))
    v = s.select("s_nationkey", "v").distinct()  # a value that many objects share has one row for each unit
    e = v.alias("s").join(v.alias("t"), (F.col("s.v") == F.col("t.v")) & (F.col("s.s_nationkey") != F.col("t.s_nationkey"))).groupBy(F.col("s.s_nationkey").alias("unit")).agg(F.count_distinct("t.s_nationkey").alias("neighbours"))
    g = s.groupBy(F.col("s_nationkey").alias("unit")).agg(F.count("*").alias("objects"), F.min("s_suppkey").alias("first_object"))
    return g.join(e, "unit", "left").select("unit", "objects", "first_object", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


_UM = ", um AS (SELECT a.allocation_id, a.unit_id, a.method_id AS model_a, b.method_id AS model_b, b.utility - a.utility AS margin FROM util a JOIN util b ON a.allocation_id = b.allocation_id AND a.unit_id = b.unit_id AND a.method_id < b.method_id)\n"


def _um(spark, d):
    return cm.margins(dm.utilities(spark, d), ["allocation_id", "unit_id"], "method_id", "utility")


def sql_t(pairs: str) -> str:
    """CTE tq(p, df, t) of Student's t for the pairs (p, df) that a query selects: bisection over the substituted angle."""
    area = "list_sum(list_transform(range(1001), lambda k: (CASE WHEN k IN (0, 1000) THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(cos((lo + hi) / 2 + (pi() - lo - hi) / 2 * k / 1000), df - 1))) * (pi() - lo - hi) / 2 / 3000"
    return f"""tq AS (WITH RECURSIVE b AS (SELECT p, df, 0.0::DOUBLE AS lo, pi() / 2 AS hi, 0 AS i FROM ({pairs}) WHERE df >= 1 UNION ALL
  SELECT p, df, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * {area} > 1 - p AS below FROM b WHERE i < 55))
  SELECT p, df, sqrt(df) * tan((lo + hi) / 2) AS t FROM b WHERE i = 55)"""


_TI = """, ti AS (SELECT allocation_id, model_a, model_b, count(*) AS n, avg(margin) AS mean, stddev_samp(margin) / sqrt(count(*)) AS se FROM um GROUP BY ALL),
tm AS (SELECT *, count(*) OVER (PARTITION BY allocation_id) AS members FROM ti)
"""


@query("t_intervals", with_("util") + _UM + _TI + ", " + sql_t("SELECT DISTINCT 0.975::DOUBLE AS p, n - 1 AS df FROM ti UNION SELECT DISTINCT 1 - 0.025::DOUBLE / members, n - 1 FROM tm") + """
SELECT allocation_id, model_a, model_b, n, mean, se, mean - a.t * se AS lower, mean + a.t * se AS upper, mean - b.t * se AS joint_lower, mean + b.t * se AS joint_upper, 'ok' AS status, NULL::VARCHAR AS reason
FROM tm JOIN tq a ON a.df = n - 1 AND a.p = 0.975 JOIN tq b ON b.df = n - 1 AND b.p = 1 - 0.025::DOUBLE / members""", ("mean", "se", "lower", "upper", "joint_lower", "joint_upper"), 6)
def _(spark, d):
    m, key = _um(spark, d), ["allocation_id", "model_a", "model_b"]
    joint = inf.t_intervals(m, key, "margin", family=["allocation_id"]).select(*key, F.col("lower").alias("joint_lower"), F.col("upper").alias("joint_upper"))
    return inf.t_intervals(m, key, "margin").join(joint, key)


@query("stable_mean_se", with_("util") + _UM + "SELECT allocation_id, model_a, model_b, avg(margin) AS mean, stddev_samp(margin) / sqrt(count(*)) AS se FROM um GROUP BY ALL", ("mean", "se"))
def _(spark, d):
    key = ["allocation_id", "model_a", "model_b"]
    m = _um(spark, d)
    o = m.withColumn("o", F.min("margin").over(Window.partitionBy(*key)))
    g = o.groupBy(*key).agg(F.min("o").alias("o"), F.avg(F.col("margin") - F.col("o")).alias("c"), F.stddev_samp(F.col("margin") - F.col("o")).alias("s"), F.count("*").alias("n"))
    return g.select(*key, (F.col("o") + F.col("c")).alias("mean"), (F.col("s") / F.sqrt("n")).alias("se"))


_BT = ", uu AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS u FROM (SELECT DISTINCT unit_id FROM um)), dr AS (SELECT rep, (('0x' || md5('b1|' || rep || '|' || slot)[1:8])::BIGINT % (SELECT count(*) FROM uu)) AS u FROM (SELECT u AS slot FROM uu), (SELECT unnest(range(200)) AS rep)), bt AS (SELECT allocation_id, model_a, model_b, rep, avg(margin) AS mean FROM dr JOIN uu USING (u) JOIN um USING (unit_id) GROUP BY ALL)\n"


def _boot(spark, d):
    return inf.bootstrap_means(_um(spark, d), ["allocation_id", "model_a", "model_b"], "unit_id", "margin", 200, "b1")


@query("unit_bootstrap_means", with_("util") + _UM + _BT + "SELECT * FROM bt", ("mean",))
def _(spark, d):
    return _boot(spark, d)


@query("bootstrap_contrast_p", with_("util") + _UM + _BT + ", ob AS (SELECT allocation_id, model_a, model_b, avg(margin) AS obs FROM um GROUP BY ALL) SELECT allocation_id, model_a, model_b, (1 + count(*) FILTER (mean - obs >= abs(obs) - 1e-12)) / 201.0::DOUBLE AS p FROM bt JOIN ob USING (allocation_id, model_a, model_b) GROUP BY ALL", ("p",))
def _(spark, d):
    key = ["allocation_id", "model_a", "model_b"]
    ob = _um(spark, d).groupBy(*key).agg(F.avg("margin").alias("obs"))
    return _boot(spark, d).join(ob, key).groupBy(*key).agg(((1 + F.count_if(F.col("mean") - F.col("obs") >= F.abs("obs") - 1e-12)) / 201.0).alias("p"))


#: Sign vectors of all units: every one up to 12 units, 4096 antithetic ones beyond.
_FL = """, uu AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS n FROM (SELECT DISTINCT unit_id FROM um)), nu AS (SELECT count(*) AS units FROM uu), ux AS (SELECT um.*, n, model_a[:7] = model_b[:7] AS structural FROM um JOIN uu USING (unit_id)),
sg AS (SELECT flip, n, CASE WHEN units <= 12 THEN (flip >> n) & 1 WHEN n = 0 THEN (flip >= 2048)::BIGINT ELSE ((flip >= 2048)::BIGINT + CASE WHEN n < 12 THEN (b >> (n - 1)) & 1 ELSE ('0x' || md5('f1|' || b || '|' || n)[1:8])::BIGINT % 2 END) % 2 END AS minus
 FROM (SELECT flip, CASE WHEN flip < 2048 THEN flip ELSE 4095 - flip END AS b FROM (SELECT unnest(range(4096)) AS flip)), uu, nu WHERE units > 12 OR flip < (1::BIGINT << units)),
dv AS (SELECT *, margin - avg(margin) OVER (PARTITION BY allocation_id, model_a, model_b) AS dev FROM ux{where}),
fl AS (SELECT allocation_id, model_a, model_b, flip, abs(avg(x)) / (stddev_samp(x) / sqrt(count(*))) AS t FROM (SELECT allocation_id, model_a, model_b, flip, CASE WHEN minus = 1 THEN -dev ELSE dev END AS x FROM dv JOIN sg USING (n)) GROUP BY ALL),
cr AS (SELECT allocation_id, t FROM (SELECT *, row_number() OVER (PARTITION BY allocation_id ORDER BY t) AS r, count(*) OVER (PARTITION BY allocation_id) AS flips FROM (SELECT allocation_id, flip, max(t) AS t FROM fl GROUP BY ALL)) WHERE r = ceil(0.95 * flips)),
gs AS (SELECT allocation_id, model_a, model_b, structural, avg(margin) AS m, stddev_samp(margin) / sqrt(count(*)) AS se FROM ux GROUP BY ALL)
"""


def numbered_units(spark, d):
    """Margins of all methods with their unit's place n, and the number of units."""
    m = _um(spark, d)
    units = dm.kept(inf.unit_numbers(m, "unit_id"), "units")
    return m.join(units, "unit_id"), units.count()


@query("sign_flip_max_t", with_("util") + _UM + _FL.format(where="") + "SELECT allocation_id, t AS critical FROM cr", ("critical",))
def _(spark, d):
    return _flip_critical(*numbered_units(spark, d))


def _flip_critical(x, n):
    t = inf.sign_flips(x, ["allocation_id", "model_a", "model_b"], "n", "margin", n)
    mx = t.groupBy("allocation_id", "flip").agg(F.max("t").alias("t"))
    r = F.row_number().over(Window.partitionBy("allocation_id").orderBy("t"))  # 4096 rows at most
    return mx.withColumn("r", r).where(F.col("r") == F.ceil(F.lit(0.95 * inf.flip_count(n)))).select("allocation_id", F.col("t").alias("critical"))


_ED = ", ed AS (SELECT DISTINCT allocation_id, source, target FROM tl WHERE p <= 0.3)\n"


_CL = """, cl AS (WITH RECURSIVE c AS (SELECT * FROM ed UNION SELECT c.allocation_id, c.source, e.target FROM c JOIN ed e ON c.allocation_id = e.allocation_id AND c.target = e.source) SELECT * FROM c)
"""


_DE = """, iv AS (SELECT allocation_id, model_a, model_b, m - t * se AS lower, m + t * se AS upper FROM gs JOIN cr USING (allocation_id)),
ed AS (SELECT allocation_id, model_a AS source, model_b AS target FROM iv WHERE lower > 0 UNION SELECT allocation_id, model_b, model_a FROM iv WHERE upper < 0)"""
_DT = """, ro AS (SELECT DISTINCT allocation_id, method_id AS method FROM util), cy AS (SELECT DISTINCT allocation_id FROM cl WHERE source = target),
k AS (SELECT r.*, (SELECT count(*) FROM cl WHERE cl.allocation_id = r.allocation_id AND cl.target = r.method) AS above, (SELECT count(*) FROM cl WHERE cl.allocation_id = r.allocation_id AND cl.source = r.method) AS below,
 count(*) OVER (PARTITION BY allocation_id) AS methods, EXISTS (FROM cy WHERE cy.allocation_id = r.allocation_id) AS cyclic FROM ro r)
SELECT allocation_id, method, cyclic OR above = 0 AS in_best_set, CASE WHEN cyclic THEN 1 ELSE above + 1 END AS rank_lower, CASE WHEN cyclic THEN methods ELSE methods - below END AS rank_upper, CASE WHEN cyclic THEN 'cycle' ELSE 'ranked' END AS status FROM k"""


@query("decision_sets", with_("util") + _UM + _FL.format(where="") + _DE + _CL + _DT)
def _(spark, d):
    """Best sets and rank bounds from the simultaneous intervals of the sign-flip maximum, per allocation."""
    x, n = numbered_units(spark, d)
    key = ["allocation_id", "model_a", "model_b"]
    critical = _flip_critical(x, n)
    g = x.groupBy(*key).agg(F.avg("margin").alias("m"), (F.stddev_samp("margin") / F.sqrt(F.count("*"))).alias("se")).join(critical, "allocation_id")
    half = F.col("critical") * F.col("se")
    intervals = dm.kept(g.select(*key, (F.col("m") - half).alias("lower"), (F.col("m") + half).alias("upper")), "intervals")
    return pu.decision_sets(intervals, dm.utilities(spark, d).select("allocation_id", F.col("method_id").alias("method")), ["allocation_id"])


_RG = """, ro AS (SELECT DISTINCT allocation_id, method_id AS method FROM util),
g AS (SELECT r.allocation_id, r.method,
 (SELECT count(*) FROM ed e WHERE e.allocation_id = r.allocation_id AND e.source = r.method) AS beats,
 (SELECT count(*) FROM ed e WHERE e.allocation_id = r.allocation_id AND e.target = r.method) AS beaten_by,
 (SELECT count(*) FROM cl c WHERE c.allocation_id = r.allocation_id AND c.source = r.method) AS below,
 (SELECT count(*) FROM cl c WHERE c.allocation_id = r.allocation_id AND c.target = r.method) AS above,
 (SELECT min(c.target) FROM cl c JOIN cl b ON b.allocation_id = c.allocation_id AND b.source = c.target AND b.target = c.source WHERE c.allocation_id = r.allocation_id AND c.source = r.method) AS component,
 (SELECT count(*) FROM cl c WHERE c.allocation_id = r.allocation_id AND c.source = c.target) > 0 AS cyclic FROM ro r),
h AS (SELECT *, count(*) OVER (PARTITION BY allocation_id) AS n, count(*) FILTER (beaten_by = 0) OVER (PARTITION BY allocation_id) AS sources FROM g)
SELECT allocation_id, method, beats, beaten_by, beaten_by = 0 AS is_source, beats = n - 1 AS condorcet, component, CASE WHEN NOT cyclic THEN above + 1 END AS lower, CASE WHEN NOT cyclic THEN n - below END AS upper,
 CASE WHEN cyclic THEN 'ABSTAIN_CYCLIC_REPORTED_GRAPH' WHEN sources = 1 THEN 'SUPPORTED_SINGLETON_REPORTED_GRAPH_SOURCE' ELSE 'ABSTAIN_NON_SINGLETON_REPORTED_GRAPH_SOURCE' END AS status FROM h"""


@query("reported_graph", U + _ED + _CL + _RG)
def _(spark, d):
    methods = dm.utilities(spark, d).select("allocation_id", F.col("method_id").alias("method"))
    return inf.reported_graph(_tails(spark, d).where("p <= 0.3"), methods, ["allocation_id"])


_WP = ", wp AS (SELECT model, unit, case_id, realization, max(score) FILTER (budget = 'A') AS sl, max(score) FILTER (budget = 'R') AS rl, case_id::DOUBLE + 1 AS wt FROM scores GROUP BY ALL)\n"


def _wp(spark, d):
    """Losses of each model, case and realization under budgets A (shared) and R (the rule), with weights."""
    at = lambda b: F.max(F.when(F.col("budget") == b, F.col("score")))
    return dm.scores(spark, d).groupBy("model", "unit", "case_id", "realization").agg(at("A").alias("sl"), at("R").alias("rl")).withColumn("wt", F.col("case_id").cast("double") + 1)


#: Calls of the rule: as many as the realization's number, against one of the shared strategy.
_PD = """, us AS (SELECT model, realization, unit, count(*) AS rows, sum(wt) AS w, sum(wt * sl) AS ws, sum(wt * (sl - rl)) AS wd FROM wp GROUP BY ALL),
tt AS (SELECT model, realization, sum(rows)::BIGINT AS observations, sum(w) AS tw, sum(ws) / sum(w) AS ms, sum(wd) / sum(w) AS md, count(*) AS units, sum(w * w) AS ww, max(w) AS wmax FROM us GROUP BY ALL),
cv AS (SELECT model, realization, any_value(observations) AS observations, any_value(units) AS units, any_value(ms) AS ms, any_value(md) AS md, pow(any_value(tw), 2) / any_value(ww) AS effective_units, any_value(wmax) / any_value(tw) AS largest_share,
 sum(pow(ws - ms * w, 2)) * any_value(units) / (any_value(units) - 1) / pow(any_value(tw), 2) AS c00, sum((ws - ms * w) * (wd - md * w)) * any_value(units) / (any_value(units) - 1) / pow(any_value(tw), 2) AS c01,
 sum(pow(wd - md * w, 2)) * any_value(units) / (any_value(units) - 1) / pow(any_value(tw), 2) AS c11 FROM us JOIN tt USING (model, realization) GROUP BY ALL), """ + sql_t("SELECT DISTINCT 0.975::DOUBLE AS p, units - 1 AS df FROM cv") + """,
q AS (SELECT cv.*, t, ms * ms - t * t * c00 AS a, -2 * (ms * md - t * t * c01) AS b, md * md - t * t * c11 AS c, md - 0.05 * ms AS pc, t * sqrt(greatest(0.0025 * c00 - 0.1 * c01 + c11, 0)) AS ph, t * sqrt(c11) AS zh, realization::DOUBLE AS cost FROM cv JOIN tq ON tq.df = units - 1),
ps AS (SELECT *, CASE WHEN ms <= 0 THEN 'unavailable' WHEN a <= 0 THEN 'unbounded_or_disjoint' WHEN b * b - 4 * a * c < 0 THEN 'empty_or_numerically_unstable' ELSE 'finite' END AS fs,
 CASE WHEN ms > 0 AND pc - ph > 0 THEN 'supported' WHEN ms > 0 AND pc + ph < 0 THEN 'insufficient' ELSE 'inconclusive' END AS pb, CASE WHEN md - zh > 0 THEN 'beneficial' WHEN md + zh < 0 THEN 'harmful' ELSE 'inconclusive' END AS ze, CASE WHEN cost <= 4 THEN 'satisfied' ELSE 'exceeded' END AS cc FROM q)
"""
_PDD = ("mean_shared", "mean_rule", "improvement", "reduction", "fieller_lower", "fieller_upper", "practical_contrast", "practical_lower", "practical_upper", "zero_lower", "zero_upper", "cost_ratio", "effective_units", "largest_share")


def _pairs(spark, d):
    return _wp(spark, d).withColumn("shared_calls", F.lit(1.0)).withColumn("rule_calls", F.col("realization").cast("double"))


@query("cluster_paired_summary", with_("scores") + _WP + _PD + """SELECT model, realization, observations, units, units - 1 AS degrees, 'approximate' AS interval_status, ms AS mean_shared, ms - md AS mean_rule, md AS improvement, CASE WHEN ms > 0 THEN md / ms END AS reduction,
CASE WHEN fs = 'finite' THEN (-b - sqrt(b * b - 4 * a * c)) / (2 * a) END AS fieller_lower, CASE WHEN fs = 'finite' THEN (-b + sqrt(b * b - 4 * a * c)) / (2 * a) END AS fieller_upper, fs AS fieller_status,
pc AS practical_contrast, pc - ph AS practical_lower, pc + ph AS practical_upper, pb AS practical_benefit, md - zh AS zero_lower, md + zh AS zero_upper, ze AS zero_effect, cost AS cost_ratio, cc AS cost_condition,
CASE WHEN pb = 'supported' AND cc = 'satisfied' THEN 'supported' WHEN pb = 'insufficient' OR cc = 'exceeded' THEN 'not_supported' ELSE 'inconclusive' END AS adoption, effective_units, largest_share,
array_to_string(list_filter([CASE WHEN units < 10 THEN 'few_units' END, CASE WHEN ms = 0 THEN 'no_shared_loss' END, CASE WHEN largest_share > 0.25 THEN 'one_unit_dominates' END], lambda x: x IS NOT NULL), ',') AS warnings FROM ps""", _PDD, 6)
def _(spark, d):
    return pr.paired_summary(_pairs(spark, d), ["model", "realization"], "sl", "rl", "wt", "unit", shared_calls="shared_calls", rule_calls="rule_calls")


@query("donor_weights", with_("scores") + _WP + "SELECT model, unit, case_id, realization, wt / sum(wt) OVER (PARTITION BY model, unit) AS weight FROM wp", ("weight",))
def _(spark, d):
    return _wp(spark, d).select("model", "unit", "case_id", "realization", (F.col("wt") / F.sum("wt").over(Window.partitionBy("model", "unit"))).alias("weight"))


@query("leave_one_unit_out", with_("scores") + _WP + """, u AS (SELECT model, realization, unit, sum((sl - rl) * wt) AS wd, sum(sl * wt) AS ws, sum(wt) AS w FROM wp GROUP BY ALL),
x AS (SELECT *, (sum(ws) OVER k - ws) / (sum(w) OVER k - w) AS s, (sum(wd) OVER k - wd) / (sum(w) OVER k - w) AS dd, sum(w) OVER k AS tw, sum(w * w) OVER k AS ww FROM u WINDOW k AS (PARTITION BY model, realization))
SELECT model, realization, unit AS omitted_unit, s AS mean_shared, s - dd AS mean_rule, dd AS improvement, CASE WHEN s > 0 THEN dd / s END AS reduction, dd - 0.05 * s AS practical_contrast, w / tw AS share, tw * tw / ww AS effective_units FROM x""", ("mean_shared", "mean_rule", "improvement", "reduction", "practical_contrast", "share", "effective_units"))
def _(spark, d):
    return pr.leave_one_unit_out(_wp(spark, d), ["model", "realization"], "sl", "rl", "wt", "unit")
