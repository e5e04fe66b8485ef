"""Hand-checkable cases and queries against their SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from contraspark.operators import allocation, comparison, inference, organizer, quality, regression, resampling, scoring
from contraspark.plans import registry
from contraspark.sources import storage

SF = "/root/testdata/sf0.01"
CHECKED = ["table_fingerprint", "dq_equal_support", "gene_panel_topk_variance", "allocate_blocks", "crossing_classification", "winner_selection", "policy_summary", "unit_macro_risk_curve", "holm_adjust", "unit_bootstrap_means", "max_t_bootstrap", "structural_zero_max_t", "reference_action_plan", "recompute_check"]


def rows(df):
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    want = want[sorted(want.columns)].astype(object)
    fix = lambda v: "None" if v is None or v is pd.NA or v != v else str(round(float(v), 9)) if isinstance(v, float) else str(v)
    assert rows(got) == sorted(tuple(fix(v) for v in r) for r in want.itertuples(index=False))


def test_sharing_identity(spark):
    # One gene, controls -1, 0, 1, treated 0: v = 2 and d_d = d_s + v for an effect against a state.
    s = spark.createDataFrame
    blocks = s([("a", 1, f"B{i + 1}", [float(c)]) for i, c in enumerate((-1, 0, 1))], "allocation string, depth int, block string, profile array<double>")
    targets, scales = s([("t", [0.0])], "task string, treated array<double>"), s([([1.0],)], "scale array<double>")
    for f, m in ((0.0, 0.0), (2.0, 0.0), (0.0, 2.0)):
        pred = s([("t", "f", "effect", [f]), ("t", "m", "state", [m])], "task string, model string, kind string, prediction array<double>")
        distance = scoring.reference_distance(blocks, scales)
        pairs = scoring.pair_margins(scoring.pattern_mse(scoring.role_tuple_mse(targets, blocks, pred, scales)))
        assert math.isclose(distance.first()["v"], 2.0) and scoring.identity_check(pairs, distance).first()["holds"]


def test_small_cases(spark):
    s = spark.createDataFrame
    assert s([(12.0,)], "m double").select(inference.smallest_k(F.col("m"), 0.05)).first()[0] == 8
    p = s([("f", "a", 1 / 256), ("f", "b", 1 / 128), ("f", "c", 0.5)], "fam string, name string, p double")
    assert [r["adjusted"] for r in inference.holm(p, ["fam"], "p", ["name"]).orderBy("name").collect()] == [3 / 256, 4 / 256, 0.5]
    ranks = comparison.midrank(s([("k", 5.0), ("k", 5.0), ("k", 1.0)], "k string, v double"), ["k"], "v")
    assert sorted(r["midrank"] for r in ranks.collect()) == [1.5, 1.5, 3.0]
    cost = {r["rule"]: r for r in allocation.rule_cost(allocation.rule_partitions(spark, 4)).collect()}
    assert cost["crossfit_4"]["forwards"] == 12 and cost["crossfit_4"]["unique_rows"] == 4
    half = allocation.rule_partitions(spark, 4).where("rule = 'O_half'").collect()
    assert {r["row"] for r in half if r["role"] == "input"} == {0, 1} and {r["row"] for r in half if r["role"] == "observation"} == {2, 3}
    assert math.isclose(inference.t_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-9)


def test_negative_cases(spark):
    s = spark.createDataFrame
    df = s([("x", 1.0), ("x", float("nan")), ("y", None)], "k string, v double")
    assert quality.unique_key(df, ["k"]).count() == 1 and quality.not_finite(df, "v").count() == 2
    assert inference.t_intervals(df.where("k = 'y'"), ["k"], "v", 2.0).first()["status"] == "unassessable"
    none = s([("b", "p", True, False, False)], "budget string, policy string, released boolean, supported boolean, reversal boolean").where("false")
    assert organizer.policy_summary(none).count() == 0
    assert allocation.short_strata(s([("c", "s")], "cell_id string, stratum string"), 3, 4).count() == 1


def test_row_order_does_not_matter(spark):
    cells = spark.range(60).select(F.col("id").cast("string").alias("cell_id"), (F.col("id") % 3).alias("stratum"))
    one = allocation.allocate_blocks(cells, 3, (2, 4), 2, "s")
    two = allocation.allocate_blocks(cells.orderBy(F.rand(3)).repartition(7), 3, (2, 4), 2, "s")
    assert storage.frozen_check(one, two).count() == 0
    small = one.where("depth = 2").drop("depth")
    assert small.exceptAll(one.where("depth = 4").drop("depth")).count() == 0  # depths are nested


def test_publish_once_refuses_to_overwrite(spark):
    path = storage.work_path(spark, "once")
    storage.publish_once(spark.range(3), path)
    with pytest.raises(Exception, match="already exists"):
        storage.publish_once(spark.range(3), path)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0 and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_clopper_pearson_against_sums(spark):
    got = {(r.x, r.n): (r.lower, r.upper) for r in resampling.clopper_pearson(spark.createDataFrame([(0, 10), (3, 10), (10, 10), (40, 200)], "x long, n long"), "x", "n").collect()}
    tail = lambda x, n, p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1))
    for (x, n), (lo, hi) in got.items():
        assert lo == 0 if x == 0 else abs(tail(x, n, lo) - 0.025) < 1e-4
        assert hi == 1 if x == n else abs(1 - tail(x + 1, n, hi) - 0.025) < 1e-4


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, -2.0] + 3 + rng.normal(size=60)
    df = spark.createDataFrame([(i % 3, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "fold int, a double, b double, y double")

    def solve(x, y, penalty):
        c = x - x.mean(0)
        beta = np.linalg.solve(c.T @ c + penalty * np.eye(2), c.T @ (y - y.mean()))
        return beta, y.mean() - x.mean(0) @ beta

    beta, intercept = regression.ridge_fit(df, ["a", "b"], ["y"], 1.0)["y"]
    want, at = solve(x, y, 1.0)
    assert np.allclose(beta, want) and np.isclose(intercept, at)
    fold = np.arange(60) % 3
    for r in regression.ridge_cv(df, "fold", ["a", "b"], ["y"], (0.1, 10.0), 1e-9).collect():
        fits = [solve(x[fold != f], y[fold != f], r.penalty) for f in range(3)]
        assert np.isclose(r.mse, np.mean([(y[i] - x[i] @ fits[fold[i]][0] - fits[fold[i]][1]) ** 2 for i in range(60)]))


def test_pca_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(40, 4)) * [4, 3, 2, 1]
    got = {r.id: r.scores for r in regression.pca_project(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "id", "v", 2).collect()}
    c = x - x.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose([got[i] for i in range(40)], c @ axes.T)
