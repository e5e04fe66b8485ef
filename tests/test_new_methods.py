"""Publication rules, rank sets, paired losses, streams, prefix sums, contracts: by hand and by brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contraspark.operators import contracts, inference, organizer, paired, prefix, publication, reporting, resampling, student
from contraspark.streaming import windows

PAIR = ["model_a", "model_b"]


def test_student_and_binomial(spark):
    rows = [(0.975, 1, 12.706204736), (0.975, 2, 4.3026527297), (0.975, 24, 2.0638985616), (0.95, 5, 2.0150483733), (0.9995, 3, 12.923978636)]
    df = spark.createDataFrame(rows, "p double, n int, want double")
    for r in df.select("want", student.t_quantile(F.col("p"), F.col("n")).alias("t")).collect():
        assert r.t == pytest.approx(r.want, rel=1e-9)
    pairs = spark.createDataFrame([(150, 90), (150, 150), (4000, 2100), (9, 0)], "k int, w int")
    for r in pairs.select("k", "w", student.binomial_tail(F.col("k"), F.col("w")).alias("p")).collect():
        assert r.p == pytest.approx(sum(math.comb(r.k, i) for i in range(r.w, r.k + 1)) / 2**r.k, rel=1e-10)


def test_running_sums_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.range(20000).select((F.col("id") % 3 == 0).alias("g"), ((F.col("id") * 7919) % 20011).alias("o"), (F.col("id") % 5).alias("v")).withColumn("g", F.when(F.col("o") > 50, F.col("g")))
        out = prefix.running(df, ["g"], ["o"], {"s": F.col("v")}, total="n", before={"b": F.col("o")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in (None, True, False):
        rows = sorted((r for r in out if r.g is g), key=lambda r: r.o)
        assert [r.k for r in rows] == list(range(1, len(rows) + 1)) and {r.n for r in rows} == {len(rows)}
        assert [r.s for r in rows] == np.cumsum([r.v for r in rows]).tolist() and [r.b for r in rows] == [None, *[r.o for r in rows[:-1]]]
    assert prefix.running(df.limit(0), ["g"], ["o"]).count() == 0


def _panel(spark, units, allocations, pairs, seed=0, drop=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(0.3, 1, (units, allocations, pairs))
    rows = [(u, a, f"p{p}", "q", float(x[u, a, p])) for u in range(units) for a in range(allocations) for p in range(pairs) if (u, a, p) not in drop]
    return x, spark.createDataFrame(rows, "unit long, allocation int, model_a string, model_b string, margin double")


def test_publication_rules(spark):
    x, df = _panel(spark, 6, 4, 5, drop={(2, 1, 4)})
    penalty = spark.createDataFrame([("p0", "q", 0.05), ("p1", "q", 9.0), ("p2", "q", 0.0)], "model_a string, model_b string, penalty double")
    got = {(r.rule, r.model_a): r for r in publication.publication_candidates(df, penalty, PAIR, "unit", "allocation", "margin", reps=60, seed="z").collect()}
    times = {(r.rep, r.unit): r.times for r in inference.schedule(df.select("unit").distinct(), "unit", 60, "z").collect()}
    assert len(got) == 30 and sum(times.values()) == 60 * 6
    for p in range(4):
        unit, anchor, mean = x[:, :, p].mean(1), x[:, 0, p].mean(), x[:, :, p].mean()
        d = np.sign(mean)
        boot = sorted(d * sum(times.get((r, u), 0) * unit[u] for u in range(6)) / 6 for r in range(60))
        want = {"score_margin": (anchor, abs(anchor)), "repeated_splitting": (mean, min(d * x[:, :, p].mean(0))), "cross_fitting": (mean, abs(mean)), "unit_resampling": (mean, boot[math.floor(0.05 * 59)]), "cross_fitting_first_partition": (x[:, :2, p].mean(), abs(x[:, :2, p].mean()))}
        for rule, (estimate, score) in want.items():
            r = got[rule, f"p{p}"]
            assert r.estimate == pytest.approx(estimate) and r.score == pytest.approx(score) and r.direction == ("a" if estimate > 0 else "b")
            assert r.eligible == (rule == "cross_fitting_first_partition" or score > 1e-12) and r.reason == ("eligible" if r.eligible else "score_below_floor")
    assert got["calibrated_margin", "p0"].score == pytest.approx(abs(x[:, 0, 0].mean()) - 0.05) and got["calibrated_margin", "p1"].reason == "score_below_floor"
    assert got["calibrated_margin", "p3"].reason == "no_calibration" and {got[r, "p4"].reason for r in publication.RULES} == {"incomplete_panel"} and got["score_margin", "p4"].estimate is None


def test_publication_needs_even_allocations(spark):
    _, df = _panel(spark, 3, 3, 1)
    penalty = spark.createDataFrame([], "model_a string, model_b string, penalty double")
    assert {r.reason for r in publication.publication_candidates(df, penalty, PAIR, "unit", "allocation", "margin", reps=5).collect()} == {"incomplete_panel"}
    zero = df.where("allocation < 2").withColumn("margin", F.lit(0.0))
    assert {r.reason for r in publication.publication_candidates(zero, penalty, PAIR, "unit", "allocation", "margin", reps=5).collect()} == {"direction_tie"}


def test_calibration_penalty(spark):
    rows = [(0, 0, 1.0), (0, 1, -2.0), (1, 0, 0.5), (1, 1, 0.7)]
    df = spark.createDataFrame([(u, a, "x", "y", m) for u, a, m in rows] + [(0, 1, "x", "z", 1.0)], "unit int, allocation int, model_a string, model_b string, margin double")
    got = {r.model_b: r.penalty for r in publication.calibration_penalty(df, PAIR, "unit", "allocation", 0, "margin").collect()}
    assert got == {"y": 3.0, "z": None}


def test_decision_sets(spark):
    rows = [("f", "a", "b", 0.1, 1.0), ("f", "b", "c", 0.2, 2.0), ("f", "a", "c", -1.0, 3.0), ("f", "c", "d", -2.0, -0.5), ("f", "d", "e", None, None),
            ("g", "a", "b", 0.1, 1.0), ("g", "b", "c", 0.1, 1.0), ("g", "a", "c", -2.0, -1.0)]
    iv = spark.createDataFrame(rows, "fam string, model_a string, model_b string, lower double, upper double")
    methods = spark.createDataFrame([(f, m) for f in "fgh" for m in "abcde" if f == "f" or m in "abc"], "fam string, method string")
    got = {(r.fam, r.method): (r.in_best_set, r.rank_lower, r.rank_upper) for r in publication.decision_sets(iv, methods, ["fam"]).collect()}
    # d beats c, a beats b beats c; e stands apart.
    assert [got["f", m] for m in "abcde"] == [(True, 1, 3), (False, 2, 4), (False, 4, 5), (True, 1, 4), (True, 1, 5)]
    assert [got["g", m] for m in "abc"] == [(True, 1, 3)] * 3  # a cycle
    assert [got["h", m] for m in "abc"] == [(True, 1, 3)] * 3  # no intervals


def _summary(s, r, w, u, t, target=0.05):
    units = sorted(set(u))
    v = np.column_stack([s, np.array(s) - np.array(r)])
    w = np.array(w, float)
    mean = np.average(v, weights=w, axis=0)
    z = np.array([sum(w[i] * (v[i] - mean) for i in range(len(u)) if u[i] == k) for k in units])
    g = len(units)
    return mean, g / (g - 1) * z.T @ z / w.sum() ** 2


def test_paired_summary(spark):
    rows = [("k", "u1", 4.0, 3.0, 1.0), ("k", "u1", 5.0, 3.5, 2.0), ("k", "u2", 6.0, 4.0, 1.0), ("k", "u3", 5.5, 4.5, 3.0),
            ("noisy", "u1", 0.1, 0.0, 1.0), ("noisy", "u2", 9.0, 5.0, 1.0), ("noisy", "u3", 0.2, 7.0, 1.0),
            ("zero", "u1", 0.0, 1.0, 1.0), ("zero", "u2", 0.0, 2.0, 1.0), ("single", "u1", 2.0, 1.0, 1.0), ("bad", "u1", 2.0, None, 1.0), ("bad", "u2", 2.0, 1.0, 1.0), ("bad", "u3", -2.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, unit string, s double, r double, w double").withColumn("cs", F.lit(2.0)).withColumn("cr", F.when(F.col("k") == "k", 6.0).otherwise(9.0))
    got = {r.k: r for r in paired.paired_summary(df, ["k"], "s", "r", "w", "unit", shared_calls="cs", rule_calls="cr").collect()}
    mean, cov = _summary([4, 5, 6, 5.5], [3, 3.5, 4, 4.5], [1, 2, 1, 3], ["u1", "u1", "u2", "u3"], None)
    t = 4.3026527297494637
    k = got["k"]
    assert (k.mean_shared, k.improvement, k.degrees) == (pytest.approx(mean[0]), pytest.approx(mean[1]), 2)
    spread = math.sqrt(np.array([-0.05, 1]) @ cov @ np.array([-0.05, 1]))
    assert k.practical_lower == pytest.approx(mean[1] - 0.05 * mean[0] - t * spread) and k.zero_upper == pytest.approx(mean[1] + t * math.sqrt(cov[1, 1]))
    a, b, c = mean[0] ** 2 - t * t * cov[0, 0], -2 * (mean[0] * mean[1] - t * t * cov[0, 1]), mean[1] ** 2 - t * t * cov[1, 1]
    assert k.fieller_status == "finite" and [k.fieller_lower, k.fieller_upper] == pytest.approx(sorted(np.roots([a, b, c]).real))
    assert (k.cost_ratio, k.cost_condition, k.effective_units) == (3.0, "satisfied", pytest.approx(49 / (9 + 1 + 9)))
    assert got["noisy"].fieller_status == "unbounded_or_disjoint" and got["noisy"].cost_condition == "exceeded" and got["noisy"].adoption == "not_supported"
    assert got["zero"].fieller_status == "unavailable" and got["zero"].reduction is None and got["zero"].practical_benefit == "inconclusive" and "no_shared_loss" in got["zero"].warnings
    assert (got["single"].interval_status, got["single"].improvement, got["single"].zero_lower) == ("unavailable", 1.0, None)
    assert (got["bad"].interval_status, got["bad"].improvement, got["bad"].observations) == ("unassessable", None, 3)
    few = paired.paired_summary(df, ["k"], "s", "r", "w", "unit", least_units=4).where("k = 'k'").first()
    assert few.interval_status == "unavailable" and "fewer_units_than_declared" in few.warnings and few.cost_condition == "unknown"


def test_bootstrap_summary_of_equal_units(spark):
    rows = [("same", f"u{i}", 2.0, 1.0, 1.0) for i in range(4)] + [("apart", f"u{i}", 2.0 + i, 1.0 + i * i / 7, 1.0 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, unit string, s double, r double, w double")
    got = {r.k: r for r in paired.bootstrap_summary(df, ["k"], "s", "r", "w", "unit", 200, "q").collect()}
    assert (got["same"].boot_lower, got["same"].boot_upper, got["same"].boot_benefit) == (pytest.approx(0.9), pytest.approx(0.9), "supported")
    assert got["apart"].units == 4 and got["apart"].joint_benefit in ("supported", "inconclusive")


def test_leave_one_out(spark):
    df = spark.createDataFrame([("u1", 4.0, 2.0, 1.0), ("u2", 2.0, 1.0, 3.0)], "unit string, s double, r double, w double").withColumn("k", F.lit(1))
    got = {r.omitted_unit: r for r in paired.leave_one_unit_out(df, ["k"], "s", "r", "w", "unit").collect()}
    assert (got["u1"].mean_shared, got["u1"].reduction, got["u2"].improvement, got["u1"].share) == (2.0, 0.5, 2.0, 0.25)


def test_nulls_make_a_comparison_unassessable(spark):
    rows = [("x", f"u{i}", v) for i, v in enumerate((1.0, None, 3.0, 2.0))] + [("y", f"u{i}", float(i)) for i in range(4)] + [("z", "u0", 1.0)] + [("c", f"u{i}", 2.0) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, u string, m double")
    means = {k: [r.mean for r in inference.bootstrap_means(df, ["k"], "u", "m", 20, "s").where(F.col("k") == k).collect()] for k in "xyz"}
    assert set(means["x"]) == {None} == set(means["z"]) and all(0 <= m <= 3 for m in means["y"]) and len(means["y"]) == 20
    got = {r.k: r for r in resampling.paired_intervals(df.withColumn("f", F.lit(1)), ["f"], ["k"], "u", "m", 50, "s").collect()}
    assert [got[k].reason for k in "xzc"] == ["missing_unit_margin", "missing_unit_margin", "zero_error_without_structural_identity"] and got["x"].mean is None
    assert got["y"].t_lower == pytest.approx(1.5 - 5.391949071935053 * math.sqrt(5 / 3) / 2, rel=1e-6) or got["y"].status == "unassessable"


def test_t_intervals_by_each_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", None), ("c", 1.0), ("d", 2.0), ("d", 2.0)], "k string, v double")
    got = {r.k: r for r in inference.t_intervals(df, ["k"], "v").collect()}
    assert got["a"].upper - got["a"].mean == pytest.approx(4.3026527297 / math.sqrt(3))
    assert [got[k].reason for k in "bcd"] == ["missing_unit", "insufficient_units", "zero_or_nonfinite_error"] and {got[k].status for k in "bcd"} == {"unassessable"} and got["b"].mean is None


def test_sign_counts_withhold_missing_units(spark):
    rows = [("d", "a", f"u{i}", m, v) for i in range(12) for m, v in (("p", float(i)), ("q", float(i) - 1), ("r", None if i == 3 else float(i) + (1 if i else 0)))]
    counts = inference.sign_counts(spark.createDataFrame(rows, "dataset_id string, allocation_id string, unit_id string, method_id string, utility double"))
    got = {(r.source, r.target): (r.wins, r.losses, r.ties, r.missing) for r in counts.collect()}
    assert got["p", "q"] == (12, 0, 0, 0) and got["q", "p"] == (0, 12, 0, 0) and got["r", "p"] == (10, 0, 1, 1) and len(got) == 6
    decided = {(r.source, r.target): (r.decision, r.reason) for r in inference.directional(inference.holm(inference.sign_tails(counts), ["allocation_id"], "p", ["source", "target"]), 0.05, ["allocation_id"]).collect()}
    assert decided["p", "q"] == ("DIRECTION", None) and decided["r", "p"] == ("WITHHELD", "missing_units") and decided["q", "p"] == ("NO_DIRECTION", None)


def test_directions_without_intervals_stay(spark):
    directions = spark.createDataFrame([("x", "y", "a"), ("x", "z", "b"), ("y", "z", "hold")], "model_a string, model_b string, direction string")
    iv = spark.createDataFrame([("x", "y", -2.0, -1.0)], "model_a string, model_b string, lower double, upper double")
    assert {r.model_a + r.model_b: r.outcome for r in reporting.classify_directions(directions, iv, PAIR).collect()} == {"xy": "reversed", "xz": "unresolved", "yz": "hold"}
    r = reporting.reversal_bounds(directions.withColumn("g", F.lit(1)), iv, PAIR, ["g"]).first()
    assert (r.least, r.most, r.n) == (1, 2, 3)
    same = resampling.paired_rule_bounds(directions, directions, iv, PAIR).first()
    assert (same.lower, same.upper, same.n) == (0.0, 0.0, 3)
    other = resampling.paired_rule_bounds(directions, directions.where("model_b <> 'z'"), iv, PAIR).first()
    assert (other.lower, other.upper) == (-0.5, 0.0)


def test_releases_without_assessment_stay(spark):
    d = spark.createDataFrame([("c1", "u", "b", "m1", "m2", "p", 2.0, 0.1, True, "m1"), ("c2", "u", "b", "m1", "m2", "p", 2.0, 0.1, True, "m1")], "case_id string, unit string, budget string, model_a string, model_b string, policy string, margin double, limit double, released boolean, favoured string")
    s = spark.createDataFrame([("c1", "u", "b", r, m, v) for r in "12" for m, v in (("m1", 1.0), ("m2", 3.0))], "case_id string, unit string, budget string, realization string, model string, score double")
    got = {r.case_id: (r.realizations, r.supported) for r in organizer.assess(d, s, 0.5).collect()}
    assert got == {"c1": (2, True), "c2": (0, None)}
    p = organizer.policy_summary(organizer.assess(d, s, 0.5)).first()
    assert (p.comparisons, p.n_released, p.unsupported) == (2, 2, 1)


def test_invalid_contracts_are_refused(spark):
    good = ("reference_effect", "state", True, "state", "m", "p", "o", None, None)
    rows = {1: good, 2: ("bogus", *good[1:]), 3: ("treated_state", "state", None, "state", None, None, None, None, None), 4: (*good[:4], "", *good[5:]), 5: (*good[:5], None, *good[6:]), 6: (*good[:3], "effect", *good[4:]), 7: ("treated_state", "native_effect", False, "effect", None, None, None, None, "n")}
    schema = "k int, task string, output_kind string, input_conditioned boolean, storage_encoding string, " + ", ".join(f"{c} string" for c in contracts.ROLE_FIELDS)
    before = spark.createDataFrame([(k, *r) for k, r in rows.items()], schema)
    got = {r.k: r.violations for r in contracts.active_roles(before).collect()}
    assert got == {1: [], 2: ["task"], 3: ["input_conditioned"], 4: ["empty:model_input_id", "missing:model_input_id"], 5: ["missing:prediction_reference_id"], 6: ["missing:storage_baseline_id"], 7: []}
    after = spark.createDataFrame([(1, *good[:4], "m2", "p", "o2", None, None), (2, *rows[2]), (7, *rows[7][:8], "n2"), (8, *good)], schema)
    plan = {r.k: r for r in contracts.action_plan(before, after, "k").collect()}
    assert (plan[1].plannable, plan[1].prediction_effect_action, plan[1].comparison_scope, plan[1].requires_score_recompute, plan[1].changed_fields) == (True, "recentre", "new_observed_realization", True, "model_input_id,observation_reference_id")
    assert (plan[2].reason, plan[8].reason, plan[3].reason, plan[2].prediction_action) == ("invalid_contract_before", "no_contract_before", "no_contract_after", None)
    assert (plan[7].comparison_scope, plan[7].native_state_baseline_changed, plan[7].requires_reference_record_update) == ("new_prediction_state", True, False)


def test_streams_drop_late_rows_and_equal_the_batch(spark, tmp_path):
    at = lambda *x: dt.datetime(2024, 1, *x)
    files = [[(at(1, 0, 10), "a", 1.0), (at(1, 0, 50), "a", 2.0), (at(1, 2, 5), "b", None)], [(at(1, 6, 0), "a", 4.0), (None, "a", 9.0)], [(at(1, 5, 30), "b", 8.0)], [(at(1, 0, 30), "a", 100.0)], [(at(1, 20, 0), "b", 16.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema

    def run(transform, name, per_batch):
        return windows.drain(transform(windows.read_stream(spark, str(tmp_path / "in"), schema, per_batch)), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"))

    tumble = lambda s: windows.tumbling(s, "k", "v", late="2 hours")
    got = run(tumble, "w1", 1)
    rows = sorted((r.start, r.k, r.total, r.n, r.rows) for r in got.table.collect())
    assert got.late_rows == 1 and rows == [(at(1, 0), "a", 3.0, 2, 2), (at(1, 2), "b", None, 0, 1), (at(1, 5), "b", 8.0, 1, 1), (at(1, 6), "a", 4.0, 1, 1)]
    whole = run(tumble, "w2", None)
    assert whole.late_rows == 0 and sorted(r.total for r in whole.table.where("k = 'a'").collect()) == [4.0, 103.0]
    batch = spark.read.parquet(str(tmp_path / "in")).where("ts < '2024-01-01 18:00'").groupBy(F.window("ts", "1 hour"), "k").agg(F.sum("v"), F.count("v")).count()
    assert whole.table.count() == batch
    s = run(lambda x: windows.sessions(x, "k", "v", gap="45 minutes", late="2 hours"), "s", None)
    assert sorted((r.start, r.k, r.rows) for r in s.table.collect()) == [(at(1, 0, 10), "a", 3), (at(1, 2, 5), "b", 1), (at(1, 5, 30), "b", 1), (at(1, 6), "a", 1)]
