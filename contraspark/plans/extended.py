"""Queries: studentized resampling, exact tails, rule bounds, contracts, further scores and baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contraspark.operators import contracts as ct
from contraspark.operators import paired as pr
from contraspark.operators import publication as pu
from contraspark.operators import regression as rg
from contraspark.operators import reporting as rp
from contraspark.operators import resampling as rs
from contraspark.plans import domain as dm
from contraspark.plans.decisions import _FL, _PD, _UM, _WP, U, _holm, _pairs, _um, numbered_units, sql_t
from contraspark.plans.domain import with_
from contraspark.plans.registry import query, table
from contraspark.plans.reports import _DJ, _PUB, _TB, _blocks, _candidates, _directions

_PAIRS = ["allocation_id", "model_a", "model_b"]

_DR = """, uu AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS u FROM (SELECT DISTINCT unit_id FROM um)),
dr AS (SELECT rep, (('0x' || md5('m1|' || rep || '|' || slot)[1:8])::BIGINT % (SELECT count(*) FROM uu)) AS u FROM (SELECT u AS slot FROM uu), (SELECT unnest(range(200)) AS rep)),
b0 AS (SELECT allocation_id, model_a, model_b, avg(margin) AS mean, stddev_samp(margin) / sqrt(count(*)) AS se, count(*) AS own FROM um GROUP BY ALL),
bs AS (SELECT *, own = (SELECT count(*) FROM uu) AS whole, (SELECT count(*) FROM uu) AS units, count(*) OVER (PARTITION BY allocation_id) AS m FROM b0),
pv AS (SELECT allocation_id, model_a, model_b, rep, (avg(margin) - any_value(mean)) / (stddev_samp(margin) / sqrt(count(*))) AS pt FROM dr JOIN uu USING (u) JOIN um USING (unit_id) JOIN (FROM bs WHERE whole) USING (allocation_id, model_a, model_b) GROUP BY ALL),
cr AS (SELECT allocation_id, critical FROM (SELECT *, row_number() OVER (PARTITION BY allocation_id ORDER BY critical) AS r FROM (SELECT allocation_id, rep, max(abs(pt)) AS critical FROM pv GROUP BY ALL)) WHERE r = ceil(0.95 * 199) + 1),
"""


@query("max_t_bootstrap", with_("util") + _UM + _DR + sql_t("SELECT DISTINCT 1 - 0.025::DOUBLE / m AS p, units - 1 AS df FROM bs") + """,
x AS (SELECT bs.*, CASE WHEN whole THEN mean - t * se END AS tl, CASE WHEN whole THEN mean + t * se END AS th, CASE WHEN whole THEN mean - critical * se END AS bl, CASE WHEN whole THEN mean + critical * se END AS bh FROM bs JOIN cr USING (allocation_id) JOIN tq ON tq.df = units - 1 AND tq.p = 1 - 0.025::DOUBLE / m)
SELECT allocation_id, model_a, model_b, units, CASE WHEN whole THEN mean END AS mean, CASE WHEN whole THEN se END AS se, tl AS t_lower, th AS t_upper, bl AS boot_lower, bh AS boot_upper, CASE WHEN whole THEN least(tl, bl) END AS lower, CASE WHEN whole THEN greatest(th, bh) END AS upper,
CASE WHEN whole THEN 'assessable' ELSE 'unassessable' END AS status, CASE WHEN NOT whole THEN 'missing_unit_margin' END AS reason FROM x""", ("mean", "se", "t_lower", "t_upper", "boot_lower", "boot_upper", "lower", "upper"), 6)
def _(spark, d):
    return rs.paired_intervals(_um(spark, d), ["allocation_id"], ["model_a", "model_b"], "unit_id", "margin", 200, "m1")


_SB = """, un AS (SELECT *, row_number() OVER (PARTITION BY model, realization ORDER BY unit) - 1 AS u, wd / w - 0.05 * (ws / w) AS v1, wd / w AS v0 FROM us),
dr AS (SELECT k.model, k.realization, rep, ('0x' || md5('s1|' || rep || '|' || slot)[1:8])::BIGINT % units AS u FROM cv k, (SELECT unnest(range(400)) AS rep), (SELECT unnest(range(25)) AS slot) WHERE slot < units),
dw AS (SELECT dr.model, dr.realization, rep, units, w, v1 - pc AS x1, v0 - md AS x0, pc, md FROM dr JOIN un ON un.model = dr.model AND un.realization = dr.realization AND un.u = dr.u JOIN ps ON ps.model = dr.model AND ps.realization = dr.realization),
dm AS (SELECT model, realization, rep, sum(w * x1) / sum(w) AS m1, sum(w * x0) / sum(w) AS m0, sum(w) AS tw FROM dw GROUP BY ALL),
ds AS (SELECT model, realization, rep, any_value(m1) AS m1, any_value(m0) AS m0, sqrt(any_value(units) / (any_value(units) - 1) * sum(pow(w * (x1 - m1), 2))) / any_value(tw) AS s1, sqrt(any_value(units) / (any_value(units) - 1) * sum(pow(w * (x0 - m0), 2))) / any_value(tw) AS s0 FROM dw JOIN dm USING (model, realization, rep) GROUP BY ALL),
dp AS (SELECT model, realization, rep, CASE WHEN s1 > 1e-12 THEN m1 / s1 WHEN m1 > 1e-13 THEN 'inf'::DOUBLE WHEN m1 < -1e-13 THEN '-inf'::DOUBLE ELSE 0 END AS p1, CASE WHEN s0 > 1e-12 THEN m0 / s0 WHEN m0 > 1e-13 THEN 'inf'::DOUBLE WHEN m0 < -1e-13 THEN '-inf'::DOUBLE ELSE 0 END AS p0 FROM ds),
dk AS (SELECT *, row_number() OVER (PARTITION BY model, realization ORDER BY p1, rep) AS k1, row_number() OVER (PARTITION BY model, realization ORDER BY p0, rep) AS k0 FROM dp),
dq AS (SELECT model, realization, max(p1) FILTER (k1 = 10) AS l1, max(p1) FILTER (k1 = 390) AS h1, max(p0) FILTER (k0 = 10) AS l0, max(p0) FILTER (k0 = 390) AS h0 FROM dk GROUP BY ALL),
di AS (SELECT ps.*, CASE WHEN isfinite(l1) AND isfinite(h1) THEN pc - h1 * ph / t END AS bl, CASE WHEN isfinite(l1) AND isfinite(h1) THEN pc - l1 * ph / t END AS bh, CASE WHEN isfinite(l0) AND isfinite(h0) THEN md - h0 * zh / t END AS zl, CASE WHEN isfinite(l0) AND isfinite(h0) THEN md - l0 * zh / t END AS zu FROM ps JOIN dq USING (model, realization)),
dj AS (SELECT *, CASE WHEN ms > 0 AND bl > 0 THEN 'supported' WHEN ms > 0 AND bh < 0 THEN 'insufficient' ELSE 'inconclusive' END AS bb FROM di)
"""


@query("studentized_bootstrap", with_("scores") + _WP + _PD + _SB + """SELECT model, realization, units, pc AS practical_contrast, md AS improvement, pc - ph AS practical_lower, pc + ph AS practical_upper, pb AS practical_benefit, bl AS boot_lower, bh AS boot_upper, bb AS boot_benefit, zl AS zero_boot_lower, zu AS zero_boot_upper,
CASE WHEN zl > 0 THEN 'beneficial' WHEN zu < 0 THEN 'harmful' ELSE 'inconclusive' END AS zero_boot_effect, CASE WHEN bb = pb THEN bb ELSE 'inconclusive' END AS joint_benefit,
CASE WHEN bb = pb AND bb = 'supported' AND cc = 'satisfied' THEN 'supported' WHEN (bb = pb AND bb = 'insufficient') OR cc = 'exceeded' THEN 'not_supported' ELSE 'inconclusive' END AS joint_adoption FROM dj""", ("practical_contrast", "improvement", "practical_lower", "practical_upper", "boot_lower", "boot_upper", "zero_boot_lower", "zero_boot_upper"), 6)
def _(spark, d):
    return pr.bootstrap_summary(_pairs(spark, d), ["model", "realization"], "sl", "rl", "wt", "unit", 400, "s1", shared_calls="shared_calls", rule_calls="rule_calls")


@query("structural_zero_max_t", with_("util") + _UM + _FL.format(where=" WHERE NOT structural") + "SELECT allocation_id, model_a, model_b, structural, CASE WHEN structural THEN 0 ELSE m END AS mean, CASE WHEN structural THEN 0 ELSE m - t * se END AS lower, CASE WHEN structural THEN 0 ELSE m + t * se END AS upper FROM gs JOIN cr USING (allocation_id)", ("mean", "lower", "upper"))
def _(spark, d):
    x, n = numbered_units(spark, d)
    zero = F.substring("model_a", 1, 7) == F.substring("model_b", 1, 7)
    return rs.structural_zero_intervals(x, ["allocation_id"], ["model_a", "model_b"], "n", "margin", zero, n, 0.95)


_AREA = "list_sum(list_transform(range(201), lambda k: (CASE WHEN k IN (0, 200) THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(cos({top} * k / 200), n - 2))) * {top} / 600"


@query("one_sided_root_t", with_("util") + _UM + ", g AS (SELECT allocation_id, model_a, model_b, count(*) AS n, avg(margin) AS mean, avg(margin) / (stddev_samp(margin) / sqrt(count(*))) AS t FROM um GROUP BY ALL) SELECT *, 0.5 - 0.5 * (" + _AREA.format(top="atan(t / sqrt(n - 1))") + ") / (" + _AREA.format(top="(pi() / 2)") + ") AS p FROM g", ("mean", "t", "p"))
def _(spark, d):
    return rs.root_t(_um(spark, d), _PAIRS, "margin")


_BINOMIAL = "(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m) + (n - i) * ln(1 - m))) FROM (SELECT unnest(range({lo}, {hi})) AS i))"


@query("clopper_pearson", f"""WITH RECURSIVE o AS (SELECT o_orderpriority, o_orderstatus, count(*) FILTER (o_totalprice > 200000) AS events, count(*) AS trials FROM orders GROUP BY ALL),
b AS (SELECT DISTINCT events AS x, trials AS n, side, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS k FROM o, (VALUES ('lower'), ('upper')) s(side)
  UNION ALL SELECT x, n, side, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END, k + 1 FROM (SELECT *, CASE side WHEN 'lower' THEN {_BINOMIAL.format(lo='x', hi='n + 1')} < 0.025 ELSE {_BINOMIAL.format(lo='0', hi='x + 1')} > 0.025 END AS up FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE k < 45)))
SELECT o.*, CASE WHEN events > 0 THEN l.lo ELSE 0 END AS lower, CASE WHEN events < trials THEN u.lo ELSE 1 END AS upper FROM o JOIN b l ON l.x = events AND l.n = trials AND l.side = 'lower' AND l.k = 45 JOIN b u ON u.x = events AND u.n = trials AND u.side = 'upper' AND u.k = 45""", ("lower", "upper"), 6)
def _(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 200000).alias("events"), F.count("*").alias("trials"))
    return rs.clopper_pearson(o, "events", "trials")


@query("common_coverage", _PUB + _TB + """, b AS (SELECT rule, block, count(*) AS rows FROM tb GROUP BY ALL), c AS (SELECT rule, (sum(rows) OVER (PARTITION BY rule ORDER BY block ROWS UNBOUNDED PRECEDING))::BIGINT AS count FROM b),
g AS (SELECT count, (SELECT count(*) FROM wh) AS total, count / (SELECT count(*) FROM wh) AS coverage FROM c GROUP BY count HAVING count(DISTINCT rule) = 5) SELECT 'd1' AS dataset_id, *, coalesce(count = max(count) FILTER (coverage <= 0.5) OVER (), false) AS primary FROM g""", ("coverage",))
def _(spark, d):
    return common_counts(spark, d)


def common_counts(spark, d):
    """Counts that all five rules can attain at the ends of their tie blocks."""
    pairs = _candidates(spark, d).where(F.col("rule") == pu.COMPANION).agg(F.count("*").alias("total"))
    b = _blocks(spark, d).crossJoin(F.broadcast(pairs))  # one row
    return rs.common_coverage(b.select(F.lit("d1").alias("dataset_id"), "rule", "count", "total"), ["dataset_id"], "rule", "count", "total", len(pu.RULES))


_SIGNS = "list_filter([CASE WHEN coalesce(lower, '-inf'::DOUBLE) < 0 THEN -1 END, CASE WHEN coalesce(lower, '-inf'::DOUBLE) <= 0 AND coalesce(upper, 'inf'::DOUBLE) >= 0 THEN 0 END, CASE WHEN coalesce(upper, 'inf'::DOUBLE) > 0 THEN 1 END], lambda s: s IS NOT NULL)"


@query("paired_rule_bounds", _DJ + f""", x AS (SELECT p.model_a, p.model_b, p.direction AS d1, q.direction AS d2, p.lower, p.upper FROM dj p JOIN dj q ON p.model_a = q.model_a AND p.model_b = q.model_b AND p.rule = 'score_margin' AND q.rule = 'calibrated_margin'),
k AS (SELECT count(*) FILTER (d1 <> 'hold') AS n1, count(*) FILTER (d2 <> 'hold') AS n2 FROM x), y AS (SELECT *, unnest({_SIGNS}) AS sign FROM x),
e AS (SELECT model_a, model_b, CASE WHEN (d1 = 'a' AND sign < 0) OR (d1 = 'b' AND sign > 0) THEN 1.0::DOUBLE / n1 ELSE 0 END - CASE WHEN (d2 = 'a' AND sign < 0) OR (d2 = 'b' AND sign > 0) THEN 1.0::DOUBLE / n2 ELSE 0 END AS diff FROM y, k)
SELECT sum(lo) AS lower, sum(hi) AS upper, count(*) AS n FROM (SELECT min(diff) AS lo, max(diff) AS hi FROM e GROUP BY model_a, model_b)""", ("lower", "upper"))
def _(spark, d):
    directions, iv = _directions(spark, d)
    of = lambda rule: directions.where(F.col("rule") == rule)
    return rs.paired_rule_bounds(of("score_margin"), of("calibrated_margin"), iv, ["model_a", "model_b"])


@query("topk_priority_change", with_("util") + """, r AS (SELECT *, row_number() OVER (PARTITION BY allocation_id, unit_id ORDER BY utility DESC, method_id) AS r FROM util),
t AS (SELECT allocation_id, unit_id, list_sort(list(method_id) FILTER (r <= 2)) AS top, max(utility) FILTER (r = 2) - max(utility) FILTER (r = 3) AS gap FROM r GROUP BY ALL)
SELECT a.unit_id, a.top <> b.top AS changed, coalesce(a.gap > 0.2 AND b.gap > 0.2, false) AS eligible FROM t a JOIN t b ON a.unit_id = b.unit_id AND a.allocation_id = 'A' AND b.allocation_id = 'R'""")
def _(spark, d):
    u = dm.utilities(spark, d)
    of = lambda a: u.where(F.col("allocation_id") == a)
    return rs.topk_change(of("A"), of("R"), ["unit_id"], "method_id", "utility", 2, 0.2)


@query("observed_alignment", with_("util") + _UM + """, x AS (SELECT model_a, model_b, unit_id, sign(max(margin) FILTER (allocation_id = 'A')) AS f, sign(max(margin) FILTER (allocation_id = 'R')) AS s, sign(max(margin) FILTER (allocation_id = 'N')) AS o FROM um GROUP BY ALL)
SELECT model_a, model_b, count(*) AS opposed, count(*) FILTER (o = f) AS first_agrees, count(*) FILTER (o = s) AS second_agrees FROM x WHERE f * s = -1 AND o <> 0 GROUP BY ALL""")
def _(spark, d):
    at = lambda a: F.signum(F.max(F.when(F.col("allocation_id") == a, F.col("margin"))))
    x = _um(spark, d).groupBy("model_a", "model_b", "unit_id").agg(at("A").alias("f"), at("R").alias("s"), at("N").alias("o")).where("f * s = -1 AND o <> 0")
    return x.groupBy("model_a", "model_b").agg(F.count("*").alias("opposed"), F.count_if(F.col("o") == F.col("f")).alias("first_agrees"), F.count_if(F.col("o") == F.col("s")).alias("second_agrees"))


@query("program_error_by_reference", with_("util") + """, w AS (SELECT unit_id, method_id, max(utility) FILTER (allocation_id = 'N') AS p, max(utility) FILTER (allocation_id = 'A') AS oa, max(utility) FILTER (allocation_id = 'R') AS ob FROM util GROUP BY ALL),
e AS (SELECT method_id, avg(pow(p - oa, 2)) AS error_a, avg(pow(p - ob, 2)) AS error_b, avg((ob - oa) * (2 * p - oa - ob)) AS shift FROM w GROUP BY method_id)
SELECT *, rank() OVER (ORDER BY round(error_a, 9)) <> rank() OVER (ORDER BY round(error_b, 9)) AS order_changed FROM e""", ("error_a", "error_b", "shift"))
def _(spark, d):
    at = lambda a: F.max(F.when(F.col("allocation_id") == a, F.col("utility")))
    w = dm.utilities(spark, d).groupBy("unit_id", "method_id").agg(at("N").alias("p"), at("A").alias("oa"), at("R").alias("ob"))
    p, a, b = F.col("p"), F.col("oa"), F.col("ob")
    e = w.groupBy("method_id").agg(F.avg((p - a) * (p - a)).alias("error_a"), F.avg((p - b) * (p - b)).alias("error_b"), F.avg((b - a) * (2 * p - a - b)).alias("shift"))
    rank = lambda c: F.rank().over(Window.orderBy(F.round(c, 9)))  # noqa: E731  one row per program
    return e.withColumn("order_changed", rank("error_a") != rank("error_b"))


#: Waves are customers, batches priorities in groups of customers, pools years; some batches have trained.
@query("candidate_edges", """WITH s AS (SELECT o_custkey AS wave, o_orderpriority || '/' || (o_custkey % 40) AS batch, year(o_orderdate) AS pool, o_orderstatus AS day, CASE WHEN o_orderkey % 97 = 0 THEN 'TRAIN' ELSE 'EVAL' END AS role FROM orders), t AS (SELECT DISTINCT batch FROM s WHERE role = 'TRAIN')
SELECT DISTINCT a.wave, a.batch FROM s a JOIN s b USING (wave, batch, pool) WHERE a.day = 'O' AND b.day = 'F' AND a.role = 'EVAL' AND b.role = 'EVAL' AND a.batch NOT IN (SELECT batch FROM t)""")
def _(spark, d):
    s = table(spark, d, "orders").select(
        F.col("o_custkey").alias("wave"), F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("batch"), F.year("o_orderdate").alias("pool"), F.col("o_orderstatus").alias("day"), F.when(F.col("o_orderkey") % 97 == 0, "TRAIN").otherwise("EVAL").alias("role"),
    )
    return rp.candidate_edges(s, "wave", "batch", "pool", "O", "F")


@query("matching_rejection_class", U + ", f AS (SELECT source, target, min(p) AS best, max(p) AS worst, bool_or(adjusted <= 0.3) AS once, max(m) AS size FROM hm GROUP BY ALL) SELECT source, target, CASE WHEN worst * size <= 0.3 THEN 'invariant' WHEN best > 0.3 THEN 'impossible' WHEN once THEN 'possible_not_necessary' ELSE 'unresolved' END AS class FROM f")
def _(spark, d):
    return rp.rejection_class(_holm(spark, d), ["source", "target"], ["allocation_id"], 0.3)


@query("recompute_check", "SELECT 'net' AS column, count(*) AS rows, 0::BIGINT AS missing, count(*) FILTER (o_orderkey % 7 = 0) AS different FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("total"))
    stored = o.withColumn("net", F.col("total") * 2 + F.when(F.col("o_orderkey") % 7 == 0, 1.0).otherwise(0.0))

    def derive(batches):
        for b in batches:
            yield b[["o_orderkey"]].assign(net=b["total"] * 2)

    return rs.recompute_check(stored, ["o_orderkey"], ["net"], derive)


# ---- contracts: one per order, its references from the order's columns -------------------------------


def _contracts(spark, d, shift: int):
    """Some are invalid: orders of status P have no known task, and there are null conditionings, empty and missing references, changes of kind."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    ref = lambda c, m: F.when(k % (m + 8) == 0, F.lit("")).when(k % m != 0, F.concat(F.lit("r"), ((k + shift * (k % 5 == c).cast("int")) % 11).cast("string")))
    task = F.when((o["o_orderstatus"] == "P") | (k % 43 == 0), "other").when((o["o_orderstatus"] == "O") != ((k % 7 == 0) & F.lit(shift > 0)), "reference_effect").otherwise("treated_state")
    return o.select(
        k.alias("contract_id"), task.alias("task"), F.when((k + shift * (k % 29 == 0).cast("int")) % 3 == 0, "native_effect").otherwise("state").alias("output_kind"),
        F.when(k % 31 != 0, k % 2 == 0).alias("input_conditioned"), F.when(k % 37 == 0, "none").when((k + shift * (k % 9 == 0).cast("int")) % 4 < 2, "state").otherwise("effect").alias("storage_encoding"),
        ref(0, 13).alias("model_input_id"), ref(1, 17).alias("prediction_reference_id"), ref(2, 19).alias("observation_reference_id"), ref(3, 23).alias("storage_baseline_id"), ref(4, 29).alias("native_state_baseline_id"),
    )


def _sql_contracts(shift: int) -> str:
    ref = lambda c, m: f"CASE WHEN k % {m + 8} = 0 THEN '' WHEN k % {m} <> 0 THEN 'r' || ((k + {shift} * (k % 5 = {c})::INT) % 11) END"
    return f"""SELECT k AS contract_id, CASE WHEN o_orderstatus = 'P' OR k % 43 = 0 THEN 'other' WHEN (o_orderstatus = 'O') <> (k % 7 = 0 AND {shift > 0}) THEN 'reference_effect' ELSE 'treated_state' END AS task,
  CASE WHEN (k + {shift} * (k % 29 = 0)::INT) % 3 = 0 THEN 'native_effect' ELSE 'state' END AS output_kind, CASE WHEN k % 31 <> 0 THEN k % 2 = 0 END AS input_conditioned,
  CASE WHEN k % 37 = 0 THEN 'none' WHEN (k + {shift} * (k % 9 = 0)::INT) % 4 < 2 THEN 'state' ELSE 'effect' END AS storage_encoding,
  {ref(0, 13)} AS model_input_id, {ref(1, 17)} AS prediction_reference_id, {ref(2, 19)} AS observation_reference_id, {ref(3, 23)} AS storage_baseline_id, {ref(4, 29)} AS native_state_baseline_id FROM (SELECT *, o_orderkey AS k FROM orders)"""


#: The needs of each field, as SQL.
_NEEDS = {
    "model_input_id": "coalesce(input_conditioned, false)", "prediction_reference_id": "task = 'reference_effect' AND output_kind = 'state'", "observation_reference_id": "task = 'reference_effect'",
    "storage_baseline_id": "storage_encoding <> (CASE WHEN output_kind = 'state' THEN 'state' ELSE 'effect' END)", "native_state_baseline_id": "task = 'treated_state' AND output_kind = 'native_effect'",
}
_joined = lambda items: f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), ',')"
_VALID = f"""SELECT *, {_joined([f"CASE WHEN {n} THEN '{c}' END" for c, n in _NEEDS.items()])} AS active, {_joined([f"CASE WHEN ({n}) AND coalesce({c}, '') = '' THEN '{c}' END" for c, n in _NEEDS.items()])} AS missing,
{_joined(["CASE WHEN task NOT IN ('treated_state', 'reference_effect') THEN 'task' END", "CASE WHEN storage_encoding NOT IN ('state', 'effect') THEN 'storage_encoding' END", "CASE WHEN input_conditioned IS NULL THEN 'input_conditioned' END", *[f"CASE WHEN {c} = '' THEN 'empty:{c}' END" for c in _NEEDS], *[f"CASE WHEN ({n}) AND coalesce({c}, '') = '' THEN 'missing:{c}' END" for c, n in _NEEDS.items()]])} AS violations"""
_CT = f"WITH b AS ({_VALID} FROM ({_sql_contracts(0)})), a AS ({_VALID} FROM ({_sql_contracts(1)}))\n"


@query("contract_validation", _CT + "SELECT contract_id, active, missing, violations, violations = '' AS valid FROM b")
def _(spark, d):
    text = [F.array_join(c, ",").alias(c) for c in ("active", "missing", "violations")]
    return ct.active_roles(_contracts(spark, d, 0)).select("contract_id", *text, "valid")


_CHANGED = {c: f"a.{c} IS DISTINCT FROM b.{c}" for c in ct.FIELDS}
_FLAGS = """task_type_changed AS requires_task_declaration, prediction_reference_changed OR observation_reference_changed AS requires_reference_record_update, definition AS requires_prediction_definition_update, model_input_changed OR definition OR observation_reference_changed AS requires_score_recompute,
task_type_changed, model_input_changed, prediction_reference_changed, observation_reference_changed, native_state_baseline_changed, definition AS prediction_definition_changed, task_type_changed OR observation_reference_changed AS observed_realization_changed, storage_encoding_changed, storage_baseline_changed, changed_fields"""


@query("reference_action_plan", _CT + f""", x AS (SELECT contract_id, CASE WHEN b.violations <> '' THEN 'invalid_contract_before' WHEN a.violations <> '' THEN 'invalid_contract_after' WHEN {_CHANGED['output_kind']} THEN 'output_kind_changed' WHEN {_CHANGED['input_conditioned']} THEN 'input_conditioned_changed' END AS reason,
a.task = 'reference_effect' AS eff, a.output_kind = 'state' AS st, {_CHANGED['task']} AS task_type_changed, a.input_conditioned AND {_CHANGED['model_input_id']} AS model_input_changed, a.task = 'reference_effect' AND a.output_kind = 'state' AND {_CHANGED['prediction_reference_id']} AS prediction_reference_changed,
a.task = 'reference_effect' AND {_CHANGED['observation_reference_id']} AS observation_reference_changed, a.task <> 'reference_effect' AND a.output_kind <> 'state' AND {_CHANGED['native_state_baseline_id']} AS native_state_baseline_changed, {_CHANGED['storage_encoding']} AS storage_encoding_changed,
(a.storage_encoding <> (CASE WHEN a.output_kind = 'state' THEN 'state' ELSE 'effect' END) OR b.storage_encoding <> (CASE WHEN b.output_kind = 'state' THEN 'state' ELSE 'effect' END)) AND {_CHANGED['storage_baseline_id']} AS storage_baseline_changed,
{_joined([f"CASE WHEN {x} THEN '{c}' END" for c, x in _CHANGED.items()])} AS changed_fields FROM a JOIN b USING (contract_id)),
y AS (SELECT *, task_type_changed OR prediction_reference_changed OR native_state_baseline_changed AS definition FROM x),
z AS (SELECT contract_id, CASE WHEN model_input_changed THEN 'load_or_generate_for_new_input' ELSE 'reuse' END AS prediction_action,
CASE WHEN NOT eff THEN 'unused' WHEN NOT st AND model_input_changed THEN 'select_new_native_effect_without_centring' WHEN st AND (task_type_changed OR prediction_reference_changed OR model_input_changed) THEN 'recentre' ELSE 'preserve' END AS prediction_effect_action,
CASE WHEN task_type_changed OR observation_reference_changed THEN 'rebuild' ELSE 'preserve' END AS observed_target_action,
CASE WHEN task_type_changed THEN 'new_task' WHEN observation_reference_changed THEN 'new_observed_realization' WHEN prediction_reference_changed THEN 'new_prediction_effect' WHEN native_state_baseline_changed THEN 'new_prediction_state' ELSE 'same_declared_quantity' END AS comparison_scope, {_FLAGS} FROM y WHERE reason IS NULL)
SELECT x.contract_id, reason IS NULL AS plannable, reason, z.* EXCLUDE (contract_id) FROM x LEFT JOIN z USING (contract_id)""")
def _(spark, d):
    return ct.action_plan(_contracts(spark, d, 0), _contracts(spark, d, 1), "contract_id")


# ---- scores of fixed roles, baselines ----------------------------------------------------------------

def _design(spark, d):
    li = table(spark, d, "lineitem")
    num = lambda c: F.col(c).cast("double")
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") % 5).alias("fold"),
        (num("l_quantity") / 50).alias("x1"), (num("l_discount") * 10).alias("x2"), (num("l_tax") * 10).alias("x3"), (num("l_extendedprice") / 1e4).alias("y1"), (num("l_extendedprice") * (1 - num("l_discount")) / 1e4).alias("y2"),
    )


_RIDGE = """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity::DOUBLE / 50 AS x1, l_discount::DOUBLE * 10 AS x2, l_tax::DOUBLE * 10 AS x3, l_extendedprice::DOUBLE / 1e4 AS y1, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) / 1e4 AS y2 FROM lineitem),
m AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(x3) AS a3, avg(y1) AS b1, avg(y2) AS b2, count(*) * var_pop(x1) + 1 AS c11, count(*) * var_pop(x2) + 1 AS c22, count(*) * var_pop(x3) + 1 AS c33, count(*) * covar_pop(x1, x2) AS c12, count(*) * covar_pop(x1, x3) AS c13, count(*) * covar_pop(x2, x3) AS c23,
  [count(*) * covar_pop(x1, y1), count(*) * covar_pop(x1, y2)] AS d1, [count(*) * covar_pop(x2, y1), count(*) * covar_pop(x2, y2)] AS d2, [count(*) * covar_pop(x3, y1), count(*) * covar_pop(x3, y2)] AS d3 FROM x),
-- Three equations by determinants, for each of the two outputs.
e AS (SELECT k, a1, a2, a3, CASE k WHEN 1 THEN b1 ELSE b2 END AS b, c11, c12, c13, c22, c23, c33, d1[k] AS d1, d2[k] AS d2, d3[k] AS d3, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c13 * c23) + c13 * (c12 * c23 - c13 * c22) AS det FROM m, (SELECT unnest([1, 2]) AS k)),
f AS (SELECT k, a1, a2, a3, b, (d1 * (c22 * c33 - c23 * c23) - c12 * (d2 * c33 - c23 * d3) + c13 * (d2 * c23 - c22 * d3)) / det AS w1, (c11 * (d2 * c33 - c23 * d3) - d1 * (c12 * c33 - c13 * c23) + c13 * (c12 * d3 - c13 * d2)) / det AS w2,
  (c11 * (c22 * d3 - c23 * d2) - c12 * (c12 * d3 - c13 * d2) + d1 * (c12 * c23 - c13 * c22)) / det AS w3 FROM e)
"""
_HAT = "{f}.b + {f}.w1 * (x1 - {f}.a1) + {f}.w2 * (x2 - {f}.a2) + {f}.w3 * (x3 - {f}.a3)"


@query("baseline_additive_ridge", _RIDGE + f"SELECT id, line, {_HAT.format(f='p')} AS y1_hat, {_HAT.format(f='q')} AS y2_hat FROM x, f p, f q WHERE p.k = 1 AND q.k = 2", ("y1_hat", "y2_hat"), 6)
def _(spark, d):
    x = _design(spark, d)
    return rg.ridge_predict(x, ["x1", "x2", "x3"], rg.ridge_fit(x, ["x1", "x2", "x3"], ["y1", "y2"], 1.0)).select("id", "line", "y1_hat", "y2_hat")


@query("ridge_alpha_cv")
def _(spark, d):
    return rg.ridge_cv(_design(spark, d), "fold", ["x1", "x2", "x3"], ["y1", "y2"], (0.1, 1.0, 10.0, 100.0), 1e-6)


@query("lowrank_effect_predict", """WITH c AS (SELECT label AS component, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS gene FROM embeddings WHERE label < 3), k AS (SELECT component, gene, avg(v) AS v FROM c GROUP BY ALL), p AS (SELECT component, unnest(range(6)) AS compound FROM (SELECT unnest(range(3)) AS component))
SELECT compound, gene::INT AS gene, sum((0.5 + 0.1 * component + 0.01 * compound * (component + 1)) * v) AS effect FROM p JOIN k USING (component) GROUP BY ALL""", ("effect",))
def _(spark, d):
    k = dm.cells(spark, d).where("stratum < 3").select(F.col("stratum").alias("component"), F.posexplode("profile").alias("gene", "v")).groupBy("component", "gene").agg(F.avg("v").alias("v"))
    i = F.col("id").cast("int")
    intercept = spark.range(3).select(i.alias("component"), (0.5 + 0.1 * i).alias("coefficient"))
    compound = spark.range(18).select((i / 3).cast("int").alias("compound"), (i % 3).alias("component"), (0.01 * (i / 3).cast("int") * (i % 3 + 1)).alias("coefficient"))
    return rg.lowrank_effect(intercept, compound, "compound", k)


@query("pca_project")
def _(spark, d):
    return rg.pca_project(dm.cells(spark, d), "cell_id", "profile", 8)
