"""Queries: reporting rules, programs, baselines, matchings, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contraspark.operators import comparison as cm
from contraspark.operators import inference as inf
from contraspark.operators import organizer as og
from contraspark.operators import publication as pu
from contraspark.operators import quality
from contraspark.operators import reporting as rp
from contraspark.operators import scoring as sc
from contraspark.operators.prefix import running
from contraspark.plans import base
from contraspark.plans import domain as dm
from contraspark.plans.decisions import _BASE, _UM, U, _holm, _um
from contraspark.plans.domain import with_
from contraspark.plans.registry import once, query, table
from contraspark.sources.storage import work_path
from contraspark.streaming import pseudobulk as pb
from contraspark.streaming.windows import drain, read_stream, sessions, tumbling


@query("calibration_penalty", _BASE + "SELECT budget, model_a, model_b, max(shift) AS penalty FROM sh WHERE unit::INT < 3 GROUP BY ALL", ("penalty",))
def _(spark, d):
    return og.shifts(dm.development(spark, d)).where("int(unit) < 3").groupBy(*og.PAIR).agg(F.max("shift").alias("penalty"))


#: The panel of the reporting rules: units are supplier nations, allocations line numbers modulo four (0 the anchor), methods brands.
#: A brand's losses grow with its number, so that rules have something to find.
#: Nations divisible by five calibrate, the others publish; the rules' companion of cross-fitting stands beside them.
_PUB = """WITH pn AS (SELECT s_nationkey AS unit_id, l_linenumber % 4 AS allocation, p_brand AS method_id, avg(l_quantity::DOUBLE) * (1 + p_brand[7:]::INT / 20) AS utility
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
pm AS (SELECT a.unit_id, a.allocation, a.method_id AS model_a, b.method_id AS model_b, b.utility - a.utility AS margin FROM pn a JOIN pn b ON a.unit_id = b.unit_id AND a.allocation = b.allocation AND a.method_id < b.method_id),
cu AS (SELECT unit_id, model_a, model_b, max(margin) FILTER (allocation = 0) AS a, max(margin) AS hi, min(margin) AS lo FROM pm WHERE unit_id % 5 = 0 GROUP BY ALL),
pe AS (SELECT model_a, model_b, CASE WHEN NOT bool_or(a IS NULL) THEN max(greatest(hi - a, a - lo)) END AS penalty FROM cu GROUP BY ALL),
pb AS (SELECT * FROM pm WHERE unit_id % 5 <> 0),
pu AS (SELECT model_a, model_b, unit_id, count(*) AS n, count(DISTINCT allocation) AS na, avg(margin) AS mean, avg(margin) FILTER (allocation = 0) AS at0, avg(margin) FILTER (allocation < 2) AS first FROM pb GROUP BY ALL),
sp AS (SELECT count(DISTINCT unit_id) AS nu, count(DISTINCT allocation) AS al FROM pb),
w0 AS (SELECT model_a, model_b, count(*) = any_value(nu) AND sum(n) = any_value(nu * al) AND min(na) = any_value(al) AS ok, avg(mean) AS mean, avg(at0) AS at0, avg(first) AS first FROM pu, sp GROUP BY model_a, model_b),
wh AS (SELECT model_a, model_b, CASE WHEN ok THEN mean END AS mean, CASE WHEN ok THEN at0 END AS at0, CASE WHEN ok THEN first END AS first FROM w0),
po AS (SELECT model_a, model_b, allocation AS r, avg(margin) AS v FROM pb GROUP BY ALL),
ur AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS u FROM (SELECT DISTINCT unit_id FROM pb)),
dr AS (SELECT rep, (('0x' || md5('p1|' || rep || '|' || slot)[1:8])::BIGINT % (SELECT count(*) FROM ur)) AS u FROM (SELECT u AS slot FROM ur), (SELECT unnest(range(200)) AS rep)),
bo AS (SELECT model_a, model_b, rep AS r, avg(mean) AS v FROM dr JOIN ur USING (u) JOIN pu USING (unit_id) GROUP BY ALL),
sg AS (SELECT *, CASE WHEN mean > 1e-12 THEN 1 WHEN mean < -1e-12 THEN -1 ELSE 0 END AS d FROM wh WHERE mean IS NOT NULL),
el AS (SELECT model_a, model_b, (SELECT min(d * v) FROM po WHERE po.model_a = sg.model_a AND po.model_b = sg.model_b) AS split FROM sg),
eb AS (SELECT model_a, model_b, x AS boot FROM (SELECT model_a, model_b, d * v AS x, row_number() OVER (PARTITION BY model_a, model_b ORDER BY d * v, r) AS k FROM bo JOIN sg USING (model_a, model_b)) WHERE k = floor(199 * 0.05) + 1),
rw AS (SELECT model_a, model_b, unnest(['score_margin', 'repeated_splitting', 'cross_fitting', 'unit_resampling', 'calibrated_margin', 'cross_fitting_first_partition']) AS rule, unnest([at0, mean, mean, mean, at0, first]) AS estimate,
  unnest([abs(at0), split, abs(mean), boot, abs(at0) - penalty, abs(first)]) AS score0 FROM wh LEFT JOIN el USING (model_a, model_b) LEFT JOIN eb USING (model_a, model_b) LEFT JOIN pe USING (model_a, model_b)),
rs AS (SELECT rule, model_a, model_b, estimate, CASE WHEN estimate IS NOT NULL THEN score0 END AS score, CASE WHEN estimate > 1e-12 THEN 'a' WHEN estimate < -1e-12 THEN 'b' WHEN estimate IS NOT NULL THEN 'hold' END AS direction FROM rw),
pd AS (SELECT rule, model_a, model_b, estimate, direction, score, CASE WHEN estimate IS NULL THEN 'incomplete_panel' WHEN direction = 'hold' THEN 'direction_tie' WHEN score IS NULL THEN 'no_calibration'
  WHEN rule = 'cross_fitting_first_partition' OR score > 1e-12 THEN 'eligible' ELSE 'score_below_floor' END AS reason FROM rs)
"""
_MODELS = ["model_a", "model_b"]
#: Scores closer than this share a block.
_TIE = 0.02


def _panel(spark, d):
    j = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    u = j.groupBy(F.col("s_nationkey").alias("unit_id"), (F.col("l_linenumber") % 4).alias("allocation"), F.col("p_brand").alias("method_id")).agg(F.avg(F.col("l_quantity").cast("double")).alias("utility"))
    u = u.withColumn("utility", F.col("utility") * (1 + F.substring("method_id", 7, 2).cast("int") / 20))
    return dm.kept(cm.margins(u, ["unit_id", "allocation"], "method_id", "utility"), "panel")


def _candidates(spark, d):
    """All rules on the panel, made once for a query."""

    def make():
        m = _panel(spark, d)
        penalty = pu.calibration_penalty(m.where("unit_id % 5 = 0"), _MODELS, "unit_id", "allocation", 0, "margin")
        return dm.kept(pu.publication_candidates(m.where("unit_id % 5 <> 0"), penalty, _MODELS, "unit_id", "allocation", "margin"), "candidates")

    return once(("candidates", d), make)


@query("publication_candidates", _PUB + "SELECT *, reason = 'eligible' AS eligible FROM pd", ("estimate", "score"))
def _(spark, d):
    return _candidates(spark, d)


_ELIGIBLE = ", eg AS (SELECT * FROM pd WHERE reason = 'eligible' AND rule <> 'cross_fitting_first_partition')\n"
_TB = _ELIGIBLE[:-1] + """, tb AS (SELECT *, sum(new) OVER (PARTITION BY rule ORDER BY score DESC, model_a, model_b ROWS UNBOUNDED PRECEDING) AS block
  FROM (SELECT rule, model_a, model_b, score, CASE WHEN lag(score) OVER w - score <= 0.02 THEN 0 ELSE 1 END AS new FROM eg WINDOW w AS (PARTITION BY rule ORDER BY score DESC, model_a, model_b)))
"""


def _eligible(spark, d):
    return _candidates(spark, d).where(F.col("eligible") & (F.col("rule") != pu.COMPANION))


def _blocks(spark, d):
    return once(("blocks", d), lambda: dm.kept(rp.tie_blocks(_eligible(spark, d), ["rule"], "score", _MODELS, _TIE), "blocks"))


@query("score_tie_blocks", _PUB + _TB + ", b AS (SELECT rule, block, count(*) AS rows, max(score) AS top, min(score) AS bottom FROM tb GROUP BY ALL) SELECT rule, block::BIGINT AS block, rows, top, bottom, (sum(rows) OVER (PARTITION BY rule ORDER BY block ROWS UNBOUNDED PRECEDING))::BIGINT AS count FROM b", ("top", "bottom"))
def _(spark, d):
    return _blocks(spark, d)


@query("threshold_intervals", _PUB + _ELIGIBLE + "SELECT rule, k, min(score) FILTER (r <= k) AS lower, max(score) FILTER (r > k) AS upper FROM (SELECT rule, score, row_number() OVER (PARTITION BY rule ORDER BY score DESC, model_a, model_b) AS r FROM eg), (SELECT unnest([2, 5, 10, 100]) AS k) GROUP BY ALL", ("lower", "upper"))
def _(spark, d):
    x = running(_eligible(spark, d), ["rule"], [F.desc("score"), *_MODELS], rank="r").withColumn("k", F.explode(F.array(*[F.lit(i) for i in (2, 5, 10, 100)])))
    return x.groupBy("rule", "k").agg(F.min(F.when(F.col("r") <= F.col("k"), F.col("score"))).alias("lower"), F.max(F.when(F.col("r") > F.col("k"), F.col("score"))).alias("upper"))


#: Later intervals: one error around the mean on the lines that were not returned or sent back; directions that are not eligible are held.
_IV = with_("util")[5:-1] + """, um AS (SELECT a.allocation_id, a.unit_id, a.method_id AS model_a, b.method_id AS model_b, b.utility - a.utility AS margin FROM util a JOIN util b ON a.allocation_id = b.allocation_id AND a.unit_id = b.unit_id AND a.method_id < b.method_id),
iv AS (SELECT model_a, model_b, avg(margin) - 1.0 * stddev_samp(margin) / sqrt(count(*)) AS lower, avg(margin) + 1.0 * stddev_samp(margin) / sqrt(count(*)) AS upper FROM um WHERE allocation_id = 'N' GROUP BY ALL),
dj AS (SELECT rule, model_a, model_b, CASE WHEN reason = 'eligible' THEN direction ELSE 'hold' END AS direction, lower, upper FROM pd LEFT JOIN iv USING (model_a, model_b) WHERE rule <> 'cross_fitting_first_partition')
"""
_DJ = _PUB + ", " + _IV


def _intervals(spark, d):
    return inf.t_intervals(_um(spark, d).where("allocation_id = 'N'"), _MODELS, "margin", quantile=1.0).select(*_MODELS, "lower", "upper")


def _directions(spark, d):
    """Reported directions of all rules, and the intervals that judge them."""
    c = _candidates(spark, d).where(F.col("rule") != pu.COMPANION)
    return c.select("rule", *_MODELS, F.when(F.col("eligible"), F.col("direction")).otherwise("hold").alias("direction")), _intervals(spark, d)


_OUT = "CASE WHEN direction = 'hold' THEN 'hold' WHEN CASE WHEN direction = 'a' THEN lower ELSE -upper END > 0 THEN 'supported' WHEN CASE WHEN direction = 'a' THEN upper ELSE -lower END < 0 THEN 'reversed' ELSE 'unresolved' END"


@query("classify_directions", _DJ + f"SELECT rule, model_a, model_b, direction, {_OUT} AS outcome FROM dj")
def _(spark, d):
    return rp.classify_directions(*_directions(spark, d), _MODELS).select("rule", *_MODELS, "direction", "outcome")


@query("rule_delta_counts", _DJ + f", c AS (SELECT rule, count(*) FILTER (o = 'reversed') AS rev, count(*) FILTER (o = 'unresolved') AS unr FROM (SELECT rule, {_OUT} AS o FROM dj) GROUP BY ALL) SELECT x.rule AS rule_a, y.rule AS rule_b, y.rev - x.rev AS reversed, y.unr - x.unr AS unresolved FROM c x JOIN c y ON x.rule < y.rule")
def _(spark, d):
    c = rp.classify_directions(*_directions(spark, d), _MODELS).groupBy("rule").agg(F.count_if(F.col("outcome") == "reversed").alias("rev"), F.count_if(F.col("outcome") == "unresolved").alias("unr"))
    x, y = c.alias("x"), c.alias("y")
    return x.join(y, F.col("x.rule") < F.col("y.rule")).select(F.col("x.rule").alias("rule_a"), F.col("y.rule").alias("rule_b"), (F.col("y.rev") - F.col("x.rev")).alias("reversed"), (F.col("y.unr") - F.col("x.unr")).alias("unresolved"))


_BOUNDS = "count(*) FILTER ((direction = 'a' AND coalesce(upper, 'inf'::DOUBLE) < 0) OR (direction = 'b' AND coalesce(lower, '-inf'::DOUBLE) > 0)) AS least, count(*) FILTER ((direction = 'a' AND coalesce(lower, '-inf'::DOUBLE) < 0) OR (direction = 'b' AND coalesce(upper, 'inf'::DOUBLE) > 0)) AS most, count(*) AS n"


@query("panel_risk_bounds", _DJ + f"SELECT rule, {_BOUNDS} FROM dj GROUP BY ALL")
def _(spark, d):
    return rp.reversal_bounds(*_directions(spark, d), _MODELS, ["rule"])


@query("pool_exclusion_sensitivity", with_("util") + _UM + """, p AS (SELECT unnest(range(4))::INT AS pool), f AS (SELECT model_a, model_b, avg(margin) AS whole FROM um GROUP BY ALL)
SELECT pool, model_a, model_b, avg(margin) AS mean, sign(avg(margin)) <> sign(any_value(whole)) AS changed FROM um JOIN f USING (model_a, model_b), p WHERE unit_id::INT % 4 <> pool GROUP BY ALL""", ("mean",))
def _(spark, d):
    m = _um(spark, d)
    f = m.groupBy("model_a", "model_b").agg(F.avg("margin").alias("whole"))
    x = m.withColumn("pool", F.explode(F.array(*[F.lit(i) for i in range(4)]))).where("int(unit_id) % 4 <> pool").groupBy("pool", "model_a", "model_b").agg(F.avg("margin").alias("mean"))
    return x.join(f, ["model_a", "model_b"]).select("pool", "model_a", "model_b", "mean", (F.signum("mean") != F.signum("whole")).alias("changed"))


#: A receipt is one inference on a control cell of a stratum; strata 0 and 1 calibrate. Later rules take from the cache what an earlier one (by name) has run.
@query("work_accounting", base._RULE_CELLS + """, us AS (SELECT rule, CASE WHEN stratum < 2 THEN 'calibration' ELSE 'publication' END AS part, cell_id AS receipt, cell_id AS control, rule || '/' || direction || '/' || stratum AS scored FROM rp WHERE role = 'input'),
rc AS (SELECT cell_id AS receipt, 1 + length(cell_id) AS forwards, cell_id::INT % 3 = 0 AS cached, 0.25::DOUBLE AS seconds FROM cells),
x AS (SELECT CASE WHEN a THEN rule END AS rule, CASE WHEN b THEN part END AS partition, receipt, control, scored FROM us, (VALUES (true, true), (true, false), (false, false)) v(a, b)),
u AS (SELECT rule, partition, count(DISTINCT control) AS controls, count(DISTINCT scored) AS scored, sum(forwards)::BIGINT AS uncached_forwards FROM x JOIN rc USING (receipt) GROUP BY ALL),
w AS (SELECT rule, partition, count(*) AS receipts, count(*) FILTER (cached) AS cached_receipts, sum(forwards)::BIGINT AS forwards, (sum(forwards) FILTER (NOT cached))::BIGINT AS executed_forwards, sum(seconds) AS seconds FROM (SELECT DISTINCT rule, partition, receipt FROM x) JOIN rc USING (receipt) GROUP BY ALL)
SELECT u.*, receipts, cached_receipts, forwards, executed_forwards, seconds FROM u JOIN w ON u.rule IS NOT DISTINCT FROM w.rule AND u.partition IS NOT DISTINCT FROM w.partition""", ("seconds",))
def _(spark, d):
    part = F.when(F.col("stratum") < 2, "calibration").otherwise("publication")
    used = base._rule_cells(spark, d).where("role = 'input'").select("rule", part.alias("partition"), F.col("cell_id").alias("receipt"), F.col("cell_id").alias("control"), F.concat_ws("/", "rule", "direction", "stratum").alias("scored"))
    receipts = dm.controls(spark, d).select(F.col("cell_id").alias("receipt"), (1 + F.length("cell_id")).alias("forwards"), (F.col("cell_id").cast("int") % 3 == 0).alias("cached"), F.lit(0.25).alias("seconds"))
    return rp.work_accounting(used, receipts)


# ---- programs and baselines ----------------------------------------------------------------------

_R = with_("role")
_EFF = ", eff AS (SELECT task, gene, t - c AS value FROM ltrain JOIN lcontrol USING (gene)), ob AS (SELECT task, gene, y - c AS value FROM ltargets JOIN lcontrol USING (gene)), pg AS (SELECT unnest(range(64)) AS gene, gene % 8 AS program_id)\n"
_PS = ", ps AS (SELECT task, program_id::INT AS program_id, avg({t}.value / s) AS score, count(*) AS covered FROM {t} JOIN lcontrol USING (gene) JOIN (SELECT gene, gene % 8 AS program_id FROM lcontrol) USING (gene) GROUP BY ALL)\n"


def _effects(spark, d):
    """(train effects, observed effects) in long form, programs, scales."""
    control = sc.mean_profile(dm.controls(spark, d).withColumn("one", F.lit(1)), ["one"]).select(F.col("profile").alias("c"))
    long = lambda df, p: df.crossJoin(F.broadcast(control)).select("task", F.posexplode(sc.minus(p, "c")).alias("gene", "value"))
    train = dm.predictions(spark, d).where("model = 'train_state'")
    scales = dm.scales(spark, d).select(F.posexplode("scale").alias("gene", "scale"))
    return long(train, "prediction"), long(dm.targets(spark, d), "treated"), scales.select("gene", (F.col("gene") % 8).alias("program_id")), scales


def _programs(spark, d, which=0):
    e = _effects(spark, d)
    return rp.program_scores(e[which], e[2], e[3], 8, 0.1)


@query("program_scores", _R + _EFF.replace(", pg AS (SELECT unnest(range(64)) AS gene, gene % 8 AS program_id)", "") + _PS.format(t="eff") + "SELECT * FROM ps", ("score",))
def _(spark, d):
    return _programs(spark, d)


_EFF = _EFF.replace(", pg AS (SELECT unnest(range(64)) AS gene, gene % 8 AS program_id)", "")


@query("program_absolute_rank", _R + _EFF + _PS.format(t="eff") + "SELECT task, program_id, rank() OVER (PARTITION BY task ORDER BY round(abs(score), 9) DESC) AS rank FROM ps")
def _(spark, d):
    return _programs(spark, d).select("task", "program_id", F.rank().over(Window.partitionBy("task").orderBy(F.desc(F.round(F.abs("score"), 9)))).alias("rank"))


_TOP = ", tg AS (SELECT task, gene, value, 'e' AS w FROM eff UNION ALL SELECT task, gene, value, 'o' FROM ob), tk AS (SELECT * FROM tg QUALIFY row_number() OVER (PARTITION BY w, task ORDER BY abs(value) DESC, gene) <= 10)\n"


@query("gene_topk_overlap", _R + _EFF + _TOP + "SELECT coalesce(a.task, b.task) AS task, count(a.gene + b.gene) / count(*)::DOUBLE AS jaccard, CASE WHEN count(a.gene + b.gene) > 0 THEN count(*) FILTER (sign(a.value) = sign(b.value)) / count(a.gene + b.gene)::DOUBLE END AS same_sign FROM (SELECT * FROM tk WHERE w = 'e') a FULL JOIN (SELECT * FROM tk WHERE w = 'o') b ON a.task = b.task AND a.gene = b.gene GROUP BY 1", ("jaccard", "same_sign"))
def _(spark, d):
    e = _effects(spark, d)
    return rp.topk_overlap(e[0], e[1], ["task"], 10)


@query("direction_discordance", _R + _EFF + _PS.format(t="eff") + _PS.format(t="ob").replace("ps AS", "po AS") + "SELECT count(*) AS pairs, count(DISTINCT task) AS tasks, count(DISTINCT program_id) AS programs FROM ps JOIN po USING (task, program_id) WHERE ps.score * po.score < 0 AND abs(ps.score) > 0.01 AND abs(po.score) > 0.01")
def _(spark, d):
    a, b = _programs(spark, d), _programs(spark, d, 1).select("task", "program_id", F.col("score").alias("other"))
    x = a.join(b, ["task", "program_id"]).where((F.col("score") * F.col("other") < 0) & (F.abs("score") > 0.01) & (F.abs("other") > 0.01))
    return x.agg(F.count("*").alias("pairs"), F.count_distinct("task").alias("tasks"), F.count_distinct("program_id").alias("programs"))


@query("baseline_no_change", _R + "SELECT task, gene::INT AS gene, 0.0::DOUBLE AS value FROM ltargets")
def _(spark, d):
    return _effects(spark, d)[1].select("task", "gene", F.lit(0.0).alias("value"))


@query("baseline_context_mean", _R + _EFF + "SELECT task % 2 AS context, gene::INT AS gene, avg(value) AS value FROM eff GROUP BY ALL", ("value",))
def _(spark, d):
    return _effects(spark, d)[0].groupBy((F.col("task") % 2).alias("context"), "gene").agg(F.avg("value").alias("value"))


@query("baseline_additive", _R + _EFF + "SELECT a.task AS a, b.task AS b, a.gene::INT AS gene, a.value + b.value + c AS value FROM eff a JOIN eff b ON a.gene = b.gene AND a.task < b.task JOIN lcontrol k ON k.gene = a.gene", ("value",))
def _(spark, d):
    e = _effects(spark, d)[0]
    c = sc.mean_profile(dm.controls(spark, d).withColumn("one", F.lit(1)), ["one"]).select(F.posexplode("profile").alias("gene", "c"))
    a, b = e.select(F.col("task").alias("a"), "gene", F.col("value").alias("va")), e.select(F.col("task").alias("b"), "gene", F.col("value").alias("vb"))
    return a.join(b, "gene").where("a < b").join(F.broadcast(c), "gene").select("a", "b", "gene", (F.col("va") + F.col("vb") + F.col("c")).alias("value"))


@query("additive_design", "SELECT o_orderkey AS cell, token, 1 AS value FROM (SELECT o_orderkey, unnest(['ctx:' || o_orderstatus, 'cmp:' || o_orderpriority]) AS token FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("cell"), F.explode(F.array(F.concat(F.lit("ctx:"), "o_orderstatus"), F.concat(F.lit("cmp:"), "o_orderpriority"))).alias("token"), F.lit(1).alias("value"))


@query("representative_task", _R + _EFF + ", n AS (SELECT task, sqrt(sum(value * value)) AS v FROM eff GROUP BY task) SELECT task, v FROM n ORDER BY round(abs(v - (SELECT median(v) FROM n)), 9), task LIMIT 1", ("v",))
def _(spark, d):
    n = _effects(spark, d)[0].groupBy("task").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("v"))
    x = n.crossJoin(F.broadcast(n.agg(F.percentile("v", 0.5).alias("m"))))  # one row
    return x.orderBy(F.round(F.abs(F.col("v") - F.col("m")), 9), "task").limit(1).select("task", "v")


# ---- matchings: allocation = matching, unit = matched unit ----------------------------------------

#: A matching is an allocation, a graph the residue of a nation modulo five, an edge a nation and method; utilities are exact fractions over the largest number of lines of a cell.
_MS = """WITH mm AS (SELECT l_returnflag AS matching, s_nationkey % 5 AS graph, s_nationkey AS edge, p_brand AS method_id, sum(l_quantity)::DECIMAL(38,0) AS q, 1000::DECIMAL(38,0) AS d FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
ms AS (SELECT matching, graph, method_id, sum(q)::DECIMAL(38,0) AS numerator, max(d) AS denominator FROM mm GROUP BY ALL),
ml AS (SELECT *, rank() OVER (PARTITION BY matching, graph ORDER BY numerator DESC) AS rank FROM ms)
"""


def _members(spark, d):
    j = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    key = [F.col("l_returnflag").alias("matching"), (F.col("s_nationkey") % 5).alias("graph"), F.col("s_nationkey").alias("edge"), F.col("p_brand").alias("method_id")]
    g = j.groupBy(*key).agg(F.sum(F.col("l_quantity").cast("decimal(20,0)")).alias("q"))
    return once(("members", d), lambda: dm.kept(g.withColumn("d", F.lit(1000)), "members"))


def _leaders(spark, d):
    return rp.matching_means(_members(spark, d), ["matching", "graph"], "method_id", "q", "d")


@query("matching_summaries", _MS + """, mt AS (SELECT graph, count(DISTINCT matching) AS matchings FROM mm GROUP BY graph), ic AS (SELECT graph, method_id, count(DISTINCT matching) / any_value(matchings) AS frequency FROM mm JOIN mt USING (graph) GROUP BY ALL),
lc AS (SELECT graph, method_id, count(*) FILTER (rank = 1) AS times FROM ml GROUP BY ALL)
SELECT matching, graph, method_id, numerator::VARCHAR AS numerator, denominator::VARCHAR AS denominator, rank, rank = 1 AS leads, times AS leader_count, frequency FROM ml JOIN lc USING (graph, method_id) JOIN ic USING (graph, method_id)""", ("frequency",))
def _(spark, d):
    """Exact utility sums, ranks and leaders of each matching, how often a method leads its graph, and how often the graph's matchings hold it."""
    leaders = dm.kept(_leaders(spark, d), "leaders")
    count = rp.leader_class(leaders, ["graph", "method_id"]).select("graph", "method_id", F.col("times").alias("leader_count"))
    held = rp.inclusion(_members(spark, d), ["graph"], "matching", ["method_id"]).select("graph", "method_id", "frequency")
    text = [F.col(c).cast("string").alias(c) for c in ("numerator", "denominator")]
    return leaders.join(count, ["graph", "method_id"]).join(held, ["graph", "method_id"]).select("matching", "graph", "method_id", *text, "rank", "leads", "leader_count", "frequency")


@query("matching_leader_class", _MS + "SELECT method_id, count(*) FILTER (rank = 1) AS times, count(*) AS matchings, CASE WHEN bool_and(rank = 1) THEN 'necessary' WHEN bool_or(rank = 1) THEN 'possible' ELSE 'impossible' END AS leader_class FROM ml GROUP BY method_id")
def _(spark, d):
    return rp.leader_class(_leaders(spark, d), ["method_id"])


@query("additive_extrema_over_matchings", _MS + "SELECT graph, method_id, min(numerator)::VARCHAR AS least, max(numerator)::VARCHAR AS most FROM ms GROUP BY ALL")
def _(spark, d):
    return _leaders(spark, d).groupBy("graph", "method_id").agg(F.min("numerator").cast("string").alias("least"), F.max("numerator").cast("string").alias("most"))


@query("matching_sign_bounds", U + "SELECT source, target, min(wins) AS least_wins, max(wins) AS most_wins, CASE WHEN min(ties) = max(ties) THEN min(ties) END AS constant_ties, min(p) AS best_p, max(p) AS worst_p FROM tl GROUP BY ALL", ("best_p", "worst_p"))
def _(spark, d):
    return rp.sign_bounds(inf.sign_tails(inf.sign_counts(dm.utilities(spark, d))), ["source", "target"])


@query("matching_dependence", U + """SELECT source, target, count(*) AS matchings, count(*) FILTER (adjusted <= 0.3) AS rejecting, min(allocation_id) FILTER (adjusted <= 0.3) AS rejecting_matching, min(allocation_id) FILTER (coalesce(adjusted > 0.3, true)) AS other_matching,
count(*) FILTER (adjusted <= 0.3) BETWEEN 1 AND count(*) - 1 AS dependent FROM hm GROUP BY ALL""")
def _(spark, d):
    return rp.matching_dependence(_holm(spark, d), ["source", "target"], "allocation_id", 0.3)


_SB = with_("util") + ", sc AS (SELECT a.allocation_id, a.method_id AS source, b.method_id AS target, count(*) FILTER (a.utility > b.utility) AS wins, count(*) FILTER (a.utility < b.utility) AS losses FROM util a JOIN util b ON a.allocation_id = b.allocation_id AND a.unit_id = b.unit_id AND a.method_id <> b.method_id GROUP BY ALL)\n"


@query("dq_pair_symmetry", _SB + "SELECT source, target, wins + 1 AS wins, losses FROM sc WHERE source < target UNION ALL SELECT source, target, wins, losses FROM sc WHERE source > target")
def _(spark, d):
    c = inf.sign_counts(dm.utilities(spark, d)).withColumn("wins", F.when(F.col("source") < F.col("target"), F.col("wins") + 1).otherwise(F.col("wins")))
    return quality.pair_symmetry(c, ["allocation_id"]).select("source", "target", "wins", "losses")


# ---- streams -------------------------------------------------------------------------------------


@query("stream_pseudobulk", "SELECT user_id, event_type, sum(value) AS total, count(value) AS n FROM events GROUP BY ALL", ("total",))
def _(spark, d):
    return pb.drain(spark, f"{d}/events.parquet", table(spark, d, "events").schema, pb.fold, work_path(spark, "stream-out"), work_path(spark, "stream-state"))


_LATE = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


def _stream(spark, d, transform):
    events = read_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    return drain(transform(events), work_path(spark, "stream-out"), work_path(spark, "stream-state")).table


@query("stream_windows", f"""SELECT h AS start, h + INTERVAL 1 HOUR AS "end", event_type, sum(value) AS total, count(value) AS n, count(*) AS rows FROM (SELECT *, date_trunc('hour', ts) AS h FROM events WHERE ts IS NOT NULL) WHERE h + INTERVAL 1 HOUR <= {_LATE}
GROUP BY h, event_type""", ("total",))
def _(spark, d):
    """Hourly sums by type from a stream with a watermark of a day: the windows that the watermark has closed."""
    return _stream(spark, d, lambda events: tumbling(events, "event_type", "value"))


@query("stream_sessions", f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, sum(value) AS total, count(value) AS n, count(*) AS rows FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= {_LATE}""", ("total",))
def _(spark, d):
    """Sessions of users, half an hour apart, from the same stream."""
    return _stream(spark, d, lambda events: sessions(events, "user_id", "value"))
