"""Domain tables made from the given tables, in Spark and as SQL (common table expressions of the same name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contraspark.operators import allocation, scoring
from contraspark.plans.registry import once, table
from contraspark.sources.storage import keep

DEPTHS, ALLOCATIONS, SEED = (4, 8, 12), 2, "s1"
CONTROLS = "label < 4"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """case_id, unit, budget, realization, model, score: mean quantity (exact sums, so equal in every engine).

    A few thousand rows behind a join of all order lines: written once for a query, however often it needs them.
    """
    return once(("scores", d), lambda: kept(_scores(spark, d), "scores"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity")
    j = line.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = [F.col("c_nationkey").cast("string").alias("case_id"), F.col("n_regionkey").cast("string").alias("unit"), F.col("l_returnflag").alias("budget"), F.col("l_linenumber").cast("string").alias("realization"), F.col("c_mktsegment").alias("model")]
    return j.groupBy(*key).agg(F.avg(F.col("l_quantity").cast("double")).alias("score"))


def development(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).where(F.col("case_id").cast("int") % 2 == 0)


def assessment(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).where(F.col("case_id").cast("int") % 2 == 1)


def utilities(spark: SparkSession, d: str) -> DataFrame:
    """dataset_id, allocation_id, unit_id, method_id, utility: mean quantity by supplier nation and brand; written once for a query."""
    return once(("utilities", d), lambda: kept(_utilities(spark, d), "utilities"))


def _utilities(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    key = [F.lit("d1").alias("dataset_id"), F.col("l_returnflag").alias("allocation_id"), F.col("s_nationkey").cast("string").alias("unit_id"), F.col("p_brand").alias("method_id")]
    return j.groupBy(*key).agg(F.avg(F.col("l_quantity").cast("double")).alias("utility"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, stratum, profile (array of double)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("cell_id"), F.col("label").alias("stratum"), F.col("embedding").cast("array<double>").alias("profile"))


def controls(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).where("stratum < 4")


def long_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("cell_id", "stratum", F.posexplode("profile").alias("gene", "value"))


def halves(spark: SparkSession, d: str) -> DataFrame:
    """Treated cells with half = train or target, by hash rank within their label; made once for a query."""
    return once(("halves", d), lambda: kept(allocation.hash_split(cells(spark, d).where("stratum >= 4"), "stratum", "cell_id", SEED), "halves"))


def membership(spark: SparkSession, d: str) -> DataFrame:
    return allocation.allocate_blocks(controls(spark, d), 3, DEPTHS, ALLOCATIONS, SEED)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """allocation, depth, block, profile."""
    return scoring.mean_profile(membership(spark, d).join(controls(spark, d).drop("stratum"), "cell_id"), ["allocation", "depth", "block"])


def targets(spark: SparkSession, d: str) -> DataFrame:
    """task, treated (profile of the target half)."""
    return scoring.mean_profile(halves(spark, d).where("half = 'target'"), ["stratum"]).select(F.col("stratum").alias("task"), F.col("profile").alias("treated"))


def targets_of_all(spark: SparkSession, d: str) -> DataFrame:
    """task, gene, y: mean of all treated cells."""
    return long_cells(spark, d).where("stratum >= 4").groupBy(F.col("stratum").alias("task"), "gene").agg(F.avg("value").alias("y"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """task, model, kind, prediction: fixed effects and states from the train half and all controls."""
    train = scoring.mean_profile(halves(spark, d).where("half = 'train'"), ["stratum"]).select(F.col("stratum").alias("task"), F.col("profile").alias("t"))
    control = scoring.mean_profile(controls(spark, d).withColumn("one", F.lit(1)), ["one"]).select(F.col("profile").alias("c"))
    both = train.crossJoin(F.broadcast(control))  # one row
    make = lambda name, kind, e: F.struct(F.lit(name).alias("model"), F.lit(kind).alias("kind"), e.alias("prediction"))
    zip2 = lambda f: F.zip_with("t", "c", f)
    models = F.array(
        make("shrunk_state", "state", zip2(lambda t, c: 0.5 * t + 0.5 * c)), make("train_effect", "effect", zip2(lambda t, c: t - c)),
        make("train_state", "state", zip2(lambda t, c: t * 1.0)), make("zero_effect", "effect", zip2(lambda t, c: t * 0.0)),
    )
    return both.select("task", F.explode(models).alias("m")).select("task", "m.*")


def scales(spark: SparkSession, d: str) -> DataFrame:
    """One row: scale per gene, sample deviation of controls, 0.1 at least."""
    s = controls(spark, d).select(F.posexplode("profile").alias("gene", "value")).groupBy("gene").agg(F.greatest(F.stddev_samp("value"), F.lit(0.1)).alias("s"))
    return s.agg(F.array_sort(F.collect_list(F.struct("gene", "s"))).alias("x")).select(F.transform("x", lambda v: v["s"]).alias("scale"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, gene, cnt from order lines."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), (F.col("l_partkey") % 50).alias("gene")).agg(F.sum("l_quantity").cast("long").alias("cnt"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """A small table that a query reads several times, written once to shared storage."""
    return keep(df, name)


def conditioned(train: DataFrame, blocks: DataFrame) -> DataFrame:
    """task, allocation, depth, input, model, kind, prediction: a state and an effect that depend on the input block."""
    j = train.crossJoin(F.broadcast(blocks.withColumnRenamed("block", "input")))  # few blocks
    make = lambda name, kind, f: F.struct(F.lit(name).alias("model"), F.lit(kind).alias("kind"), F.zip_with("t", "profile", f).alias("prediction"))
    models = F.array(make("block_effect", "effect", lambda t, b: t - b), make("block_state", "state", lambda t, b: 0.5 * t + 0.5 * b))
    return j.select("task", "allocation", "depth", "input", F.explode(models).alias("m")).select("task", "allocation", "depth", "input", "m.*")


def tuple_scores(spark: SparkSession, d: str) -> DataFrame:
    return once(("tuples", d), lambda: _tuple_scores(spark, d))


def _tuple_scores(spark: SparkSession, d: str) -> DataFrame:
    b, p = kept(blocks(spark, d), "blocks"), kept(predictions(spark, d), "predictions")
    train = p.where("model = 'train_state'").select("task", F.col("prediction").alias("t"))
    scores = scoring.role_tuple_mse(kept(targets(spark, d), "targets"), b, p, kept(scales(spark, d), "scales"), conditioned(train, b))
    return kept(scores, "tuples")


SQL = {
    "scores": """scores AS (SELECT c_nationkey::VARCHAR AS case_id, n_regionkey::VARCHAR AS unit, l_returnflag AS budget, l_linenumber::VARCHAR AS realization, c_mktsegment AS model, avg(l_quantity::DOUBLE) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""",
    "dev": "dev AS (SELECT * FROM scores WHERE case_id::INT % 2 = 0)",
    "asm": "asm AS (SELECT * FROM scores WHERE case_id::INT % 2 = 1)",
    "util": """util AS (SELECT 'd1' AS dataset_id, l_returnflag AS allocation_id, s_nationkey::VARCHAR AS unit_id, p_brand AS method_id, avg(l_quantity::DOUBLE) AS utility
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)""",
    "cells": "cells AS (SELECT vec_id::VARCHAR AS cell_id, label AS stratum, embedding::DOUBLE[] AS profile FROM embeddings)",
    "lcells": "lcells AS (SELECT cell_id, stratum, unnest(range(len(profile))) AS gene, unnest(profile) AS value FROM cells)",
    "halves": """halves AS (SELECT cell_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY sha256('s1|split|' || cell_id), cell_id) <= count(*) OVER (PARTITION BY stratum) // 2 THEN 'train' ELSE 'target' END AS half
  FROM cells WHERE stratum >= 4)""",
    "ranked": """ranked AS (SELECT a.allocation, cell_id, stratum, row_number() OVER (PARTITION BY a.allocation, stratum ORDER BY sha256('s1|' || a.allocation || '|' || cell_id), cell_id) - 1 AS r
  FROM cells, (SELECT unnest(range(2))::VARCHAR AS allocation) a WHERE stratum < 4)""",
    "depths": "depths AS (SELECT unnest([4, 8, 12]) AS depth)",
    "member": "member AS (SELECT allocation, depth, cell_id, stratum, 'B' || (r % 3 + 1) AS block, r // 3 AS within_block_index FROM ranked, depths WHERE r // 3 < depth)",
    "lblocks": "lblocks AS (SELECT allocation, depth, block, gene, avg(value) AS value FROM member JOIN lcells USING (cell_id) GROUP BY ALL)",
    "ltargets": "ltargets AS (SELECT l.stratum AS task, gene, avg(value) AS y FROM halves h JOIN lcells l USING (cell_id) WHERE half = 'target' GROUP BY ALL)",
    "lcontrol": "lcontrol AS (SELECT gene, avg(value) AS c, greatest(stddev_samp(value), 0.1) AS s FROM lcells WHERE stratum < 4 GROUP BY gene)",
    "ltrain": "ltrain AS (SELECT l.stratum AS task, gene, avg(value) AS t FROM halves h JOIN lcells l USING (cell_id) WHERE half = 'train' GROUP BY ALL)",
    "lpred": """lpred AS (SELECT task, gene, 'shrunk_state' AS model, 'state' AS kind, 0.5 * t + 0.5 * c AS p FROM ltrain JOIN lcontrol USING (gene) UNION ALL
  SELECT task, gene, 'train_effect', 'effect', t - c FROM ltrain JOIN lcontrol USING (gene) UNION ALL SELECT task, gene, 'train_state', 'state', t FROM ltrain UNION ALL SELECT task, gene, 'zero_effect', 'effect', 0.0 FROM ltrain)""",
    "counts": "counts AS (SELECT l_orderkey AS cell_id, l_partkey % 50 AS gene, sum(l_quantity)::BIGINT AS cnt FROM lineitem GROUP BY ALL)",
    "lcond": """lcond AS (SELECT task, gene, allocation, depth, block AS input, 'block_effect' AS model, 'effect' AS kind, t - value AS p FROM ltrain JOIN lblocks USING (gene) UNION ALL
  SELECT task, gene, allocation, depth, block, 'block_state', 'state', 0.5 * t + 0.5 * value FROM ltrain JOIN lblocks USING (gene))""",
    "tuples": """tuples AS (SELECT task, bo.allocation, bo.depth, model, kind, false AS conditioned, bo.block AS observation, bp.block AS prediction, bi.block AS input,
    avg(pow(CASE WHEN kind = 'effect' THEN p - (y - bo.value) ELSE (p - y) + (bo.value - bp.value) END / s, 2)) AS mse
  FROM ltargets JOIN lpred USING (task, gene) JOIN lcontrol USING (gene) JOIN lblocks bo USING (gene) JOIN lblocks bp ON bp.gene = bo.gene AND bp.allocation = bo.allocation AND bp.depth = bo.depth
  JOIN (SELECT DISTINCT allocation, depth, block FROM member) bi ON bi.allocation = bo.allocation AND bi.depth = bo.depth GROUP BY ALL
  UNION ALL SELECT task, bo.allocation, bo.depth, model, kind, true, bo.block, bp.block, lcond.input, avg(pow(CASE WHEN kind = 'effect' THEN p - (y - bo.value) ELSE (p - y) + (bo.value - bp.value) END / s, 2))
  FROM ltargets JOIN lcond USING (task, gene) JOIN lcontrol USING (gene) JOIN lblocks bo ON bo.gene = lcond.gene AND bo.allocation = lcond.allocation AND bo.depth = lcond.depth
  JOIN lblocks bp ON bp.gene = bo.gene AND bp.allocation = bo.allocation AND bp.depth = bo.depth GROUP BY ALL)""",
    "patterns": """patterns AS (SELECT task, allocation, depth, model, kind, conditioned, CASE WHEN observation = prediction AND prediction = input THEN 'S' WHEN observation = prediction THEN 'M' WHEN observation = input THEN 'P'
    WHEN prediction = input THEN 'O' ELSE 'D' END AS pattern, avg(mse) AS mse, count(*) AS tuples FROM tuples GROUP BY ALL)""",
    "vdist": """vdist AS (SELECT allocation, depth, avg(v) AS v FROM (SELECT a.allocation, a.depth, a.block AS i, b.block AS j, avg(pow((a.value - b.value) / s, 2)) AS v
  FROM lblocks a JOIN lblocks b ON a.allocation = b.allocation AND a.depth = b.depth AND a.gene = b.gene AND a.block <> b.block JOIN lcontrol c ON a.gene = c.gene GROUP BY ALL) GROUP BY ALL)""",
}
SQL["pairs"] = """pairs AS (SELECT x.task, x.allocation, x.depth, x.model AS model_a, y.model AS model_b, x.kind AS kind_a, y.kind AS kind_b, max(CASE WHEN x.pattern = 'S' THEN y.mse - x.mse END) AS d_s, max(CASE WHEN x.pattern = 'D' THEN y.mse - x.mse END) AS d_d, NOT bool_or((x.kind = 'effect' AND x.conditioned) OR (y.kind = 'effect' AND y.conditioned)) AS applicable
  FROM patterns x JOIN patterns y ON x.task = y.task AND x.allocation = y.allocation AND x.depth = y.depth AND x.pattern = y.pattern AND ((x.kind = 'effect' AND y.kind = 'state') OR (x.kind = y.kind AND x.model < y.model)) GROUP BY ALL)"""
ROLE = ["cells", "lcells", "halves", "ranked", "depths", "member", "lblocks", "ltargets", "lcontrol", "ltrain", "lpred", "lcond", "tuples", "patterns", "vdist", "pairs"]


def with_(*names: str) -> str:
    """WITH clause of the named tables; "role" and "alloc" stand for the chains behind role scoring and allocation."""
    out = []
    for n in names:
        out += ROLE if n == "role" else ROLE[:6] if n == "alloc" else [n]
    return "WITH " + ",\n".join(SQL[n] for n in dict.fromkeys(out)) + "\n"
