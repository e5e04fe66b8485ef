"""Queries: sources, checks, profiles, allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from contraspark.operators import allocation as al
from contraspark.operators import profiles as pr
from contraspark.operators import quality as dq
from contraspark.plans import domain as dm
from contraspark.plans.domain import with_
from contraspark.plans.registry import query, table
from contraspark.sources import storage as st

w = with_


@query("read_scores", w("scores") + "SELECT * FROM scores", ("score",))
def _(spark, d):
    path = st.work_path(spark, "scores")
    st.write_tsv(dm.scores(spark, d), path)
    return st.read_tsv(spark, path, st.SCORES)


@query("read_cells_wide_to_long", w("cells", "lcells") + "SELECT cell_id, stratum, 'g' || gene AS gene, value FROM lcells", ("value",))
def _(spark, d):
    width = dm.cells(spark, d).agg(F.max(F.size("profile"))).first()[0] or 0
    wide = dm.cells(spark, d).select("cell_id", "stratum", *[F.get("profile", F.lit(i)).alias(f"g{i}") for i in range(width)])
    return st.wide_to_long(wide, ["cell_id", "stratum"])


@query("read_blocks", w("alloc", "lblocks") + "SELECT allocation, depth, block, 'g' || gene AS gene, value FROM lblocks", ("value",))
def _(spark, d):
    path = st.work_path(spark, "blocks")
    wide = dm.blocks(spark, d).select("allocation", "depth", "block", *[F.get("profile", F.lit(i)).alias(f"g{i}") for i in range(64)])
    st.write_tsv(wide, path)
    return st.wide_to_long(st.read_tsv(spark, path, wide.schema), ["allocation", "depth", "block"])


@query("align_genes", w("cells", "lcells") + """, p AS (SELECT gene, avg(value) AS value FROM lcells GROUP BY gene), g AS (SELECT unnest(range(2, 70)) AS gene, unnest(range(68)) AS idx)
SELECT coalesce(p.gene, g.gene)::INT AS gene, idx::INT AS idx, value, CASE WHEN p.gene IS NULL THEN 'missing' WHEN g.gene IS NULL THEN 'unexpected' ELSE 'ok' END AS reason FROM p FULL JOIN g ON p.gene = g.gene""", ("value",))
def _(spark, d):
    profile = dm.long_cells(spark, d).groupBy("gene").agg(F.avg("value").alias("value"))
    axis = table(spark, d, "embeddings").select(F.explode(F.sequence(F.lit(2), F.lit(69))).alias("gene")).distinct().select("gene", (F.col("gene") - 2).alias("idx"))
    return st.align_genes(profile, axis)


@query("count_triples_source", "SELECT l_orderkey AS cell_id, l_partkey % 50 AS gene, 'duplicate' AS reason FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), (F.col("l_partkey") % 50).alias("gene"), F.col("l_quantity").alias("cnt"))
    return st.count_triples(line, ["cell_id", "gene"], "cnt")


@query("publish_once", w("counts") + "SELECT * FROM counts")
def _(spark, d):
    return st.publish_once(dm.counts(spark, d), st.work_path(spark, "counts"))


_FP_TEXT = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("o_orderkey", "o_custkey", "o_orderpriority"))
_FP_SUMS = " || ',' || ".join(f"sum(('0x' || h[{8 * i + 1}:{8 * i + 8}])::BIGINT)::VARCHAR" for i in range(8))
_FP = f"SELECT count(*) AS n_rows, {_FP_SUMS} AS digest_sums, min(h) AS digest_min, max(h) AS digest_max FROM (SELECT sha256({_FP_TEXT}) AS h FROM orders)"


@query("table_fingerprint", _FP)
def _(spark, d):
    return st.table_fingerprint(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("membership_digest", w("alloc") + r"SELECT allocation, depth, block, sha256(string_agg(cell_id, chr(10) ORDER BY cell_id)) AS digest FROM member GROUP BY ALL")
def _(spark, d):
    return st.membership_digest(dm.membership(spark, d), ["allocation", "depth", "block"], "cell_id")


@query("frozen_artifact_check", w("scores", "dev") + "SELECT *, 'now' AS side FROM dev WHERE realization = '1' UNION ALL SELECT * REPLACE (score + 1 AS score), 'saved' FROM dev WHERE realization = '1'", ("score",))
def _(spark, d):
    dev = dm.development(spark, d)
    return st.frozen_check(dev, dev.withColumn("score", F.when(F.col("realization") == "1", F.col("score") + 1).otherwise(F.col("score"))))


# ---- checks --------------------------------------------------------------------------------------


@query("dq_unique_key", "SELECT o_custkey, o_orderdate, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return dq.unique_key(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@query("dq_functional_dependency", "SELECT c_nationkey, min(c_mktsegment) AS least, max(c_mktsegment) AS most FROM customer GROUP BY c_nationkey HAVING min(c_mktsegment) <> max(c_mktsegment) OR (count(c_mktsegment) > 0 AND count(c_mktsegment) < count(*))")
def _(spark, d):
    return dq.functional_dependency(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("dq_complete_support", w("scores") + """, x AS (SELECT DISTINCT case_id FROM scores), m AS (SELECT DISTINCT model FROM scores), r AS (SELECT DISTINCT realization FROM scores)
SELECT case_id, model, realization FROM x, m, r WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.case_id = x.case_id AND s.model = m.model AND s.realization = r.realization AND s.score > 24)""")
def _(spark, d):
    s = dm.scores(spark, d)
    full = dq.complete_support(s, ["case_id", "model", "realization"])
    keys = ["case_id", "model", "realization"]
    return full.union(s.select(*keys).distinct().join(s.where("score > 24").select(*keys).distinct(), keys, "left_anti").select(*full.columns)).select(*keys)


@query("dq_equal_support", w("scores") + """, o AS (SELECT case_id, budget, string_agg(DISTINCT realization, ',' ORDER BY realization) AS members FROM scores WHERE score > 20 GROUP BY ALL)
SELECT o.*, (SELECT min(members) = max(members) FROM o) AS equal FROM o""")
def _(spark, d):
    return dq.support_sets(dm.scores(spark, d).where("score > 20"), ["case_id", "budget"], "realization")


@query("dq_disjoint_partitions", "SELECT DISTINCT c_nationkey AS nation FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def _(spark, d):
    return dq.overlap(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")


@query("dq_group_partition_leak", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS partitions FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def _(spark, d):
    return dq.partition_leak(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("dq_finite", "SELECT event_id, value FROM events WHERE value IS NULL OR isnan(value) OR isinf(value) OR value < 10", ("value",))
def _(spark, d):
    return dq.not_finite(table(spark, d, "events"), "value", 10.0).select("event_id", "value")


@query("dq_anchor_equal", w("scores", "asm") + "SELECT case_id, unit, budget, model, score + 1 AS score, score AS assessed FROM asm WHERE realization = '1' AND model = 'BUILDING'", ("score", "assessed"))
def _(spark, d):
    a = dm.assessment(spark, d).where("realization = '1'").drop("realization")
    return dq.anchor_equal(a, a.withColumn("score", F.when(F.col("model") == "BUILDING", F.col("score") + 1).otherwise(F.col("score"))), ["case_id", "unit", "budget", "model"], "score")


@query("dq_membership", w("alloc") + "SELECT DISTINCT allocation, depth, block, stratum, 'ranks' AS reason FROM member WHERE depth = 12 UNION ALL SELECT DISTINCT allocation, depth, block, NULL, 'means' FROM member WHERE depth = 12 OR (depth = 8 AND block = 'B2')")
def _(spark, d):
    """Members of depth 12 are lost, and a block's reference is another at depth 8."""
    references = dm.blocks(spark, d).withColumn("profile", F.when(F.expr("depth = 8 and block = 'B2'"), F.transform("profile", lambda x: x + 0.5)).otherwise(F.col("profile")))
    return dq.membership(dm.membership(spark, d).where("depth < 12 or within_block_index <> 3"), dm.controls(spark, d), references)


_POOLS = """, roles(scheme, rotation, role, block) AS (SELECT 'shared', 'SHARED', r, b FROM (VALUES ('observation'), ('prediction'), ('input')) x(r), (VALUES ('B1'), ('B2'), ('B3')) y(b)
  UNION ALL SELECT s, t, r, 'B' || ((i + k) % 3 + 1) FROM (VALUES ('observation', 0), ('prediction', 1), ('input', 2)) x(r, i), (VALUES ('split', 'SPLIT', 0), ('crossfit', 'ROT0', 0), ('crossfit', 'ROT1', 1), ('crossfit', 'ROT2', 2)) z(s, t, k)),
pools AS (SELECT scheme, rotation, allocation, depth, role, cell_id FROM member JOIN roles USING (block))
"""


@query("dq_role_pools", w("alloc") + _POOLS + """, n AS (SELECT scheme, rotation, allocation, depth, role, count(*) AS pool FROM pools GROUP BY ALL)
SELECT a.scheme, a.rotation, a.allocation, a.depth, a.role AS role_a, b.role AS role_b, a.pool AS pool_a, b.pool AS pool_b, CASE WHEN a.scheme = 'shared' THEN a.pool ELSE 0 END AS shared, true AS allowed
FROM n a JOIN n b ON a.scheme = b.scheme AND a.rotation = b.rotation AND a.allocation = b.allocation AND a.depth = b.depth AND a.role < b.role""")
def _(spark, d):
    return dq.role_pools(al.scheme_membership(dm.membership(spark, d)))


@query("dq_constant_columns", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def _(spark, d):
    return dq.constant_columns(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": "F"})


@query("dq_complement_folds", """WITH f AS (SELECT vec_id::VARCHAR AS cell_id, label, (row_number() OVER (ORDER BY sha256('s1|fold|' || vec_id), vec_id::VARCHAR) - 1) % 4 AS fold FROM embeddings WHERE label < 9)
SELECT vec_id::VARCHAR AS cell_id, 0 AS held_out, 0 AS inputs, 'held_out' AS reason FROM embeddings WHERE label = 9 UNION ALL SELECT cell_id, 1, 2, 'inputs' FROM f WHERE label = 8 AND fold <> 0 UNION ALL SELECT 'x' || cell_id, 1, 3, 'unknown_cell' FROM f WHERE label = 7""")
def _(spark, d):
    """One stratum is in no fold, one lacks the input of fold 0, one is listed by unknown names too."""
    cells = dm.cells(spark, d)
    f = al.hash_folds(cells.where("stratum < 9").select("cell_id", "stratum"), "cell_id", 4, dm.SEED)
    f = f.union(f.where("stratum = 7").select(F.concat(F.lit("x"), "cell_id"), "stratum", "fold"))
    role = F.when(F.col("fold") == F.col("own"), "observation").otherwise("input")
    folds = f.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("role", role)
    return dq.complement_folds(folds.where("not (stratum = 8 and fold = 0 and role = 'input')"), cells)


@query("dq_table_equivalence", w("scores", "dev") + "SELECT case_id, budget, realization, model, score, score + 0.5 AS other, 'value' AS reason FROM dev WHERE budget = 'A'", ("score", "other"))
def _(spark, d):
    dev = dm.development(spark, d)
    return dq.table_equivalence(dev, dev.withColumn("score", F.when(F.col("budget") == "A", F.col("score") + 0.5).otherwise(F.col("score"))), ["case_id", "budget", "realization", "model"], "score")


# ---- profiles ------------------------------------------------------------------------------------

_NORM = ", norm AS (SELECT cell_id, gene, ln(1 + cnt * 10000.0::DOUBLE / sum(cnt) OVER (PARTITION BY cell_id)) AS value FROM counts)"
_MOM = _NORM + ", n AS (SELECT count(DISTINCT cell_id) AS n FROM counts), mom AS (SELECT gene, sum(value) / any_value(n) AS mean, greatest(sum(value * value) / any_value(n) - pow(sum(value) / any_value(n), 2), 0) AS variance FROM norm, n GROUP BY gene)\n"


def _norm(spark, d):
    return pr.normalize_cp10k(dm.counts(spark, d))


def _moments(spark, d):
    n = table(spark, d, "lineitem").select(F.count_distinct("l_orderkey")).first()[0]  # one number
    return pr.gene_moments(_norm(spark, d), n), n


@query("normalize_cp10k_log1p", w("counts") + _NORM + "SELECT * FROM norm", ("value",))
def _(spark, d):
    return _norm(spark, d)


@query("gene_panel_topk_variance", w("counts") + _MOM + "SELECT gene, variance FROM mom ORDER BY variance DESC, gene LIMIT 20", ("variance",))
def _(spark, d):
    return pr.topk_variance(_moments(spark, d)[0], 20)


@query("gene_scales", w("counts") + _MOM + "SELECT gene, greatest(sqrt(variance * n / (n - 1)), 0.1) AS scale FROM mom, n", ("scale",))
def _(spark, d):
    return pr.gene_scales(*_moments(spark, d))


@query("pseudobulk_mean", w("counts") + _NORM + """, c AS (SELECT o_orderkey AS cell_id, o_orderpriority AS grp FROM orders WHERE o_orderkey IN (SELECT cell_id FROM counts)), k AS (SELECT grp, count(*) AS n FROM c GROUP BY grp)
SELECT grp, gene, sum(value) / any_value(n) AS value FROM norm JOIN c USING (cell_id) JOIN k USING (grp) GROUP BY grp, gene""", ("value",))
def _(spark, d):
    counts = dm.counts(spark, d)
    cells = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("grp")).join(counts.select("cell_id").distinct(), "cell_id", "left_semi")
    return pr.pseudobulk_mean(pr.normalize_cp10k(counts), cells, ["grp"])


@query("equal_stratum_mean", w("cells", "lcells") + "SELECT gene::INT AS gene, avg(m) AS value FROM (SELECT stratum, gene, avg(value) AS m FROM lcells WHERE stratum < 4 GROUP BY ALL) GROUP BY gene", ("value",))
def _(spark, d):
    return pr.equal_stratum_mean(dm.long_cells(spark, d).where("stratum < 4"))


_LIB = "CASE WHEN sha256(cell_id)[1:1] < '8' THEN 'L1' ELSE 'L2' END"


@query("matched_control_effect", w("cells", "lcells") + f""", x AS (SELECT *, {_LIB} AS library FROM lcells), t AS (SELECT library, stratum, gene, avg(value) AS t FROM x WHERE stratum >= 4 GROUP BY ALL),
c AS (SELECT library, gene, avg(value) AS c FROM x WHERE stratum < 4 GROUP BY ALL) SELECT stratum, gene::INT AS gene, avg(t - c) AS value FROM t JOIN c USING (library, gene) GROUP BY stratum, gene""", ("value",))
def _(spark, d):
    lib = F.when(F.substring(F.sha2("cell_id", 256), 1, 1) < "8", "L1").otherwise("L2")
    return pr.matched_effect(dm.long_cells(spark, d).withColumn("library", lib).withColumn("treated", F.col("stratum") >= 4), "library", "treated", "stratum")


@query("select_task_pools", "SELECT o_orderpriority AS task, CASE WHEN o_orderstatus = 'O' THEN 'treated' ELSE 'control' END AS pool, o_orderkey AS cell_id FROM orders WHERE o_orderstatus IN ('O', 'F')")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("unit"), F.col("o_orderstatus").alias("condition"))
    tasks = o.select(F.col("unit").alias("task"), "unit", F.lit("O").alias("condition")).distinct()
    return pr.task_pools(o, tasks, "F")


@query("canonical_condition", "SELECT o_orderkey, array_to_string(list_sort([CASE WHEN x = 'F' THEN 'ctrl' ELSE x END FOR x IN [o_orderstatus, o_orderpriority[1:1]]]), '+') AS condition FROM orders")
def _(spark, d):
    c = table(spark, d, "orders").select("o_orderkey", F.concat_ws("+", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("c"))
    return c.select("o_orderkey", pr.canonical_condition("c", {"F": "ctrl"}).alias("condition"))


@query("eligible_tasks_by_support", "SELECT o_custkey AS task, count(*) FILTER (o_orderstatus = 'O') AS treated, count(*) FILTER (o_orderstatus = 'F') AS control FROM orders GROUP BY ALL HAVING least(count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'F')) >= 3")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderstatus") == "O", "treated").when(F.col("o_orderstatus") == "F", "control").alias("pool"))
    return pr.eligible_tasks(o, 3)


@query("latent_task_shift", w("cells", "lcells") + """, x AS (SELECT *, sha256(cell_id)[1:1] < '8' AS root FROM lcells), t AS (SELECT root, stratum, gene, avg(value) AS t FROM x WHERE stratum >= 4 GROUP BY ALL), c AS (SELECT root, gene, avg(value) AS c FROM x WHERE stratum < 4 GROUP BY ALL)
SELECT stratum, gene::INT AS gene, avg(t - c) AS value FROM t JOIN c USING (root, gene) GROUP BY stratum, gene""", ("value",))
def _(spark, d):
    root = F.substring(F.sha2("cell_id", 256), 1, 1) < "8"
    return pr.matched_effect(dm.long_cells(spark, d).withColumn("root", root).withColumn("treated", F.col("stratum") >= 4), "root", "treated", "stratum")


# ---- allocation ----------------------------------------------------------------------------------


@query("allocate_blocks", w("alloc") + "SELECT allocation, depth, cell_id, stratum, block, within_block_index::INT AS within_block_index FROM member")
def _(spark, d):
    return dm.membership(spark, d)


@query("allocate_blocks_contiguous", w("alloc") + "SELECT allocation, depth, cell_id, stratum, 'B' || (r // 12 + 1) AS block, (r % 12)::INT AS within_block_index FROM ranked, depths WHERE r < 36 AND r % 12 < depth")
def _(spark, d):
    return al.allocate_contiguous(dm.controls(spark, d), 3, dm.DEPTHS, dm.ALLOCATIONS, dm.SEED)


@query("nested_depths", w("alloc") + "SELECT allocation, block, cell_id, min(depth) AS first_depth, count(*) AS depths FROM member GROUP BY ALL")
def _(spark, d):
    return dm.membership(spark, d).groupBy("allocation", "block", "cell_id").agg(F.min("depth").alias("first_depth"), F.count("*").alias("depths"))


@query("block_means", w("alloc", "lblocks") + "SELECT allocation, depth, block, gene::INT AS gene, value FROM lblocks", ("value",))
def _(spark, d):
    return dm.blocks(spark, d).select("allocation", "depth", "block", F.posexplode("profile").alias("gene", "value"))


@query("reference_scheme_membership", w("alloc") + _POOLS + "SELECT * FROM pools")
def _(spark, d):
    return al.scheme_membership(dm.membership(spark, d))


_PLAN = """WITH plan(rule, direction, role, lo, hi) AS (VALUES ('shared_all_B', 0, 'input', 0, 8), ('shared_all_B', 0, 'observation', 0, 8), ('O_quarter', 0, 'input', 0, 2), ('O_quarter', 0, 'observation', 2, 8),
 ('O_half', 0, 'input', 0, 4), ('O_half', 0, 'observation', 4, 8), ('O_three_quarters', 0, 'input', 0, 6), ('O_three_quarters', 0, 'observation', 6, 8),
 ('crossfit_2', 0, 'observation', 0, 4), ('crossfit_2', 0, 'input', 4, 8), ('crossfit_2', 1, 'observation', 4, 8), ('crossfit_2', 1, 'input', 0, 4),
 ('crossfit_4', 0, 'observation', 0, 2), ('crossfit_4', 0, 'input', 2, 8), ('crossfit_4', 1, 'observation', 2, 4), ('crossfit_4', 1, 'input', 0, 2),
 ('crossfit_4', 1, 'input', 4, 8), ('crossfit_4', 2, 'observation', 4, 6), ('crossfit_4', 2, 'input', 0, 4), ('crossfit_4', 2, 'input', 6, 8),
 ('crossfit_4', 3, 'observation', 6, 8), ('crossfit_4', 3, 'input', 0, 6), ('overlap_half', 0, 'input', 0, 4), ('overlap_half', 0, 'observation', 0, 8),
 ('crossfit2_overlap_all', 0, 'input', 0, 4), ('crossfit2_overlap_all', 0, 'observation', 0, 8), ('crossfit2_overlap_all', 1, 'input', 4, 8), ('crossfit2_overlap_all', 1, 'observation', 0, 8)),
parts AS (SELECT rule, direction, role, unnest(range(lo, hi)) AS row FROM plan)\n"""
#: The plan over quarters of each stratum's budget, the largest multiple of four within a share of its cells.
_RULE_CELLS = _PLAN.replace("parts AS (SELECT rule, direction, role, unnest(range(lo, hi)) AS row FROM plan)", "parts AS (SELECT rule, direction, role, unnest(range(lo // 2, hi // 2)) AS row FROM plan)") + """, cells AS (SELECT vec_id::VARCHAR AS cell_id, label AS stratum FROM embeddings WHERE label < 4),
rk AS (SELECT cell_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('s1|0|' || cell_id), cell_id) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n FROM cells),
rp AS (SELECT rule, direction, role, stratum, cell_id FROM (SELECT *, n // 4 AS q FROM rk) JOIN parts ON r // q = row WHERE q > 0)
"""


def _rule_cells(spark, d, share=1.0):
    return al.partition_cells(dm.controls(spark, d), dm.SEED, share)


@query("rule_partitions", _RULE_CELLS + "SELECT * FROM rp")
def _(spark, d):
    return _rule_cells(spark, d)


@query("rule_cost", _RULE_CELLS + """SELECT rule, forwards, unique_rows, physical_rows, forwards::DOUBLE / physical_rows AS uncached_ratio, unique_rows::DOUBLE / physical_rows AS cached_ratio FROM
(SELECT rule, count(*) FILTER (role = 'input') AS forwards, count(DISTINCT cell_id) FILTER (role = 'input') AS unique_rows, count(DISTINCT cell_id) AS physical_rows FROM rp GROUP BY rule)""", ("uncached_ratio", "cached_ratio"))
def _(spark, d):
    return al.rule_cost(_rule_cells(spark, d).withColumnRenamed("cell_id", "row"))


@query("hash_split", w("cells", "halves") + "SELECT * FROM halves")
def _(spark, d):
    return dm.halves(spark, d).select("cell_id", "stratum", "half")


@query("hash_folds", "SELECT vec_id::VARCHAR AS cell_id, label AS stratum, ((row_number() OVER (PARTITION BY label ORDER BY sha256('s1|fold|' || vec_id), vec_id::VARCHAR) - 1) % 5)::INT AS fold FROM embeddings")
def _(spark, d):
    return al.hash_folds(dm.cells(spark, d).select("cell_id", "stratum"), "cell_id", 5, dm.SEED, "stratum")


@query("control_pool_disjointness", w("alloc") + "SELECT allocation, depth, cell_id, 'no control' AS reason FROM member WHERE stratum = 3")
def _(spark, d):
    m = dm.membership(spark, d)
    return m.join(dm.controls(spark, d).where("stratum < 3").select("cell_id"), "cell_id", "left_anti").select("allocation", "depth", "cell_id", F.lit("no control").alias("reason"))


@query("role_overlap_matrix", w("alloc") + _POOLS + """, o AS (SELECT scheme, rotation, role, string_agg(DISTINCT block, ',' ORDER BY block) AS blocks FROM roles WHERE block IN (SELECT block FROM member) GROUP BY ALL)
SELECT a.scheme, a.rotation, a.role AS role_a, b.role AS role_b, a.blocks = b.blocks AS same, CASE WHEN x.o = x.p AND x.p = x.i THEN 'S' WHEN x.o = x.p THEN 'M' WHEN x.o = x.i THEN 'P' WHEN x.p = x.i THEN 'O' ELSE 'D' END AS pattern FROM o a JOIN o b ON a.scheme = b.scheme AND a.rotation = b.rotation
JOIN (SELECT scheme, rotation, max(blocks) FILTER (role = 'observation') AS o, max(blocks) FILTER (role = 'prediction') AS p, max(blocks) FILTER (role = 'input') AS i FROM o GROUP BY ALL) x ON x.scheme = a.scheme AND x.rotation = a.rotation""")
def _(spark, d):
    m = dm.membership(spark, d)
    pools = al.scheme_membership(m).join(m.select("allocation", "depth", "cell_id", "block"), ["allocation", "depth", "cell_id"])
    return al.role_overlap(pools)
