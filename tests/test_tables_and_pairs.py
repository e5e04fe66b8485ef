"""Concordance, winners, matchings, work accounting, identities, partitions and checks, by brute force and by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contraspark.operators import allocation, comparison, profiles, quality, reporting, scoring
from contraspark.plans import registry


def _tau(a, b):
    s = na = nb = 0
    for i, j in itertools.combinations(range(len(a)), 2):
        x, y = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
        s, na, nb = s + x * y, na + abs(x), nb + abs(y)
    return s / math.sqrt(na * nb) if na and nb else None


def _midranks(a):
    return [sum(x < y for x in a) + (sum(x == y for x in a) - 1) / 2 for y in a]


def test_concordance_by_inversions(spark):
    rng = np.random.default_rng(4)
    groups = {"small": (rng.integers(0, 4, 9), rng.integers(0, 4, 9)), "large": (rng.integers(0, 60, 150), rng.integers(0, 60, 150)), "flat": (np.zeros(5), np.arange(5)), "same": (np.array([2.0, 0.0, -0.0, 1.0]), np.array([9.0, 3.0, 3.0, 5.0])), "one": (np.array([1.0]), np.array([1.0]))}
    rows = [(g, i, float(x), float(y)) for g, (a, b) in groups.items() for i, (x, y) in enumerate(zip(a, b, strict=True))] + [("gap", 0, 1.0, None), ("gap", 1, 2.0, 3.0), (None, 0, 1.0, 2.0), (None, 1, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, item int, x double, y double")
    got = {r.g: r for r in comparison.metric_concordance(df, ["g"], "item", "x", "y").collect()}
    for g, (a, b) in groups.items():
        want = _tau(a, b)
        assert (got[g].tau_b is None) == (want is None) and (want is None or got[g].tau_b == pytest.approx(want, abs=1e-12))
        assert got[g].ranks_identical == (_midranks(a) == _midranks(b)) and got[g].leader_sets_identical == ({i for i in range(len(a)) if a[i] == min(a)} == {i for i in range(len(b)) if b[i] == min(b)})
    assert (got["flat"].status, got["one"].status, got["gap"].status, got["gap"].ranks_identical, got[None].tau_b) == ("constant_metric", "constant_metric", "missing_score", None, -1.0)


def test_inversions_of_a_permutation(spark):
    p = np.random.default_rng(1).permutation(500)
    df = spark.createDataFrame([(1, int(i), int(v)) for i, v in enumerate(p)], "k int, place int, rank long")
    assert comparison.inversions(df, ["k"], "place", "rank", 9).first()["inversions"] == sum(p[i] > p[j] for i, j in itertools.combinations(range(500), 2))


def test_winner_stability(spark):
    rows = [("k", r, m, v) for r, values in {"r1": (1.0, 1.0, 5.0), "r2": (2.0, 2.0, 0.5), "r3": (3.0, 3.0, 9.0)}.items() for m, v in zip("xyz", values, strict=True)] + [("solo", "r1", "x", 1.0), ("solo", "r1", "y", 2.0)]
    df = spark.createDataFrame(rows, "k string, root string, model string, loss double")
    got = {(r.k, r.held_out): r for r in comparison.winner_stability(df, ["k"], "root", "model", "loss", ["y", "x"]).collect()}
    top = got["k", None]
    assert (top.winner, top.tied, top.second_gap, top.outside_gap) == ("y", 2, 0.0, pytest.approx(14.5 / 3 - 2))
    assert (got["k", "r3"].winner, got["k", "r1"].winner, got["k", "r2"].winner) == ("y", "y", "y") and top.stability == 1.0
    assert got["solo", None].stability is None and len(got) == 5
    moved = df.withColumn("loss", F.when(F.col("model") == "z", F.col("loss") - 2.5).otherwise(F.col("loss")))
    again = {r.held_out: (r.winner, r.same, r.stability) for r in comparison.winner_stability(moved.where("k = 'k'"), ["k"], "root", "model", "loss", ["y", "x"]).collect()}
    assert again[None][0] == "y" and again["r3"][:2] == ("z", False) and again["r1"][2] == pytest.approx(1 / 3)


def test_matchings_compare_exactly(spark):
    big = 10**30
    rows = [("m1", "e1", "a", big), ("m1", "e2", "a", 1), ("m1", "e1", "b", big), ("m1", "e2", "b", 0), ("m1", "e1", "c", 5), ("m2", "e1", "a", 3), ("m2", "e1", "b", 3), ("m2", "e1", "c", 1)]
    df = spark.createDataFrame([(m, e, i, str(n)) for m, e, i, n in rows], "m string, e string, item string, n string").withColumn("d", F.lit(12))
    means = reporting.matching_means(df, ["m"], "item", "n", "d")
    got = {(r.m, r.item): (int(r.numerator), r["rank"], r.leads) for r in means.collect()}
    assert got["m1", "a"] == (big + 1, 1, True) and got["m1", "b"] == (big, 2, False) and got["m2", "a"][1:] == (1, True) and got["m2", "b"][1:] == (1, True) and got["m2", "c"][1] == 3
    classes = {r.item: (r.times, r.leader_class) for r in reporting.leader_class(means, ["item"]).collect()}
    assert classes == {"a": (2, "necessary"), "b": (1, "possible"), "c": (0, "impossible")}
    held = {(r.e): (r.held, r.frequency) for r in reporting.inclusion(df.withColumn("g", F.lit(1)), ["g"], "m", ["e"]).collect()}
    assert held == {"e1": (2, 1.0), "e2": (1, 0.5)}
    with pytest.raises(Exception, match="several denominators"):
        reporting.matching_means(df.withColumn("d", F.when(F.col("e") == "e1", 12).otherwise(13)), ["m"], "item", "n", "d").collect()


def test_matching_decisions(spark):
    df = spark.createDataFrame([("m1", "a", "b", 0.01, 3, 1, 0, 0.2), ("m2", "a", "b", 0.4, 2, 1, 1, 0.5), ("m1", "b", "a", 0.9, 1, 3, 0, 0.9), ("m2", "b", "a", None, 1, 2, 0, None)], "m string, source string, target string, adjusted double, wins long, losses long, ties long, p double")
    got = {r.source: r for r in reporting.matching_dependence(df, ["source", "target"], "m", 0.05).collect()}
    assert (got["a"].dependent, got["a"].rejecting_matching, got["a"].other_matching, got["b"].dependent, got["b"].rejecting) == (True, "m1", "m2", False, 0)
    bounds = {r.source: r for r in reporting.sign_bounds(df, ["source", "target"]).collect()}
    assert (bounds["a"].least_wins, bounds["a"].most_wins, bounds["a"].constant_ties, bounds["a"].best_p, bounds["a"].worst_p, bounds["b"].constant_ties) == (2, 3, None, 0.2, 0.5, 0)


def test_work_is_counted_once(spark):
    usage = spark.createDataFrame([("r1", "p", "x1", "c1", "s1"), ("r1", "p", "x1", "c1", "s2"), ("r1", "q", "x2", "c1", "s3"), ("r2", "p", "x1", "c1", "s4"), ("r2", "p", "x3", "c2", "s4")], "rule string, partition string, receipt string, control string, scored string")
    receipts = spark.createDataFrame([("x1", 10, False, 1.0), ("x2", 5, True, 0.5), ("x3", 2, False, 2.0), ("x9", 99, False, 9.0)], "receipt string, forwards int, cached boolean, seconds double")
    got = {(r.rule, r.partition): r for r in reporting.work_accounting(usage, receipts).collect()}
    row = lambda *k: (lambda r: (r.controls, r.receipts, r.cached_receipts, r.forwards, r.executed_forwards, r.uncached_forwards, r.scored, r.seconds))(got[k])
    assert row("r1", None) == (1, 2, 1, 15, 10, 25, 3, 1.5) and row("r1", "p") == (1, 1, 0, 10, 10, 20, 2, 1.0) and row(None, None) == (2, 3, 1, 17, 12, 37, 4, 3.5) and len(got) == 6


def test_edges_need_batch_and_pool(spark):
    rows = [(1, "b1", "p1", "0", "EVAL"), (1, "b1", "p1", "7", "EVAL"), (2, "b1", "p1", "0", "EVAL"), (2, "b1", "p2", "7", "EVAL"), (3, "b2", "p1", "0", "EVAL"), (3, "b2", "p1", "7", "EVAL"), (4, "b2", "p1", "0", "TRAIN")]
    df = spark.createDataFrame(rows, "wave int, batch string, pool string, day string, role string")
    assert [tuple(r) for r in reporting.candidate_edges(df, "wave", "batch", "pool", "0", "7").collect()] == [(1, "b1")]


def test_cross_moments_and_identities(spark):
    s = spark.createDataFrame
    rng = np.random.default_rng(3)
    b, y, st = rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=(3, 4))
    scale = np.array([1.0, 2.0, 0.5, 1.5])
    blocks = s([("a", 1, f"B{i + 1}", b[i].tolist()) for i in range(3)], "allocation string, depth int, block string, profile array<double>")
    targets, scales = s([("t", y.tolist())], "task string, treated array<double>"), s([(scale.tolist(),)], "scale array<double>")
    fixed = s([("t", "fix", "state", st[0].tolist()), ("t", "eff", "effect", (st[1] - b[0]).tolist())], "task string, model string, kind string, prediction array<double>")
    own = s([("t", "a", 1, f"B{i + 1}", "own", "state", st[i].tolist()) for i in range(3)], "task string, allocation string, depth int, input string, model string, kind string, prediction array<double>")
    moments = scoring.cross_moments(scoring.states_by_input(blocks, fixed, own), targets, blocks, scales)
    got = {r.model: r for r in moments.collect()}
    pairs = list(itertools.permutations(range(3), 2))
    k = np.mean([np.mean((st[i] - y) * (b[i] - b[j]) / scale**2) for i, j in pairs])
    assert got["own"].k == pytest.approx(k) and abs(k) > 1e-3 and got["fix"].k == pytest.approx(0, abs=1e-12) and got["fix"].displacement == 0
    assert got["own"].displacement == pytest.approx(math.sqrt(np.mean([np.mean(((st[i] - st[j]) / scale) ** 2) for i, j in pairs])))
    patterns = scoring.pattern_mse(scoring.role_tuple_mse(targets, blocks, fixed, scales, own))
    rows = scoring.pattern_identities(patterns, scoring.reference_distance(blocks, scales), moments).collect()
    states = [r for r in rows if r.kind == "state"]
    assert len(states) == 2 and all(max(r.m_minus_s, r.d_minus_s_v, r.p_minus_s_v_2k, r.o_minus_s_v_2k, r.d_minus_po, r.pair_shift) < 1e-9 for r in states)
    assert [r.spread < 1e-9 for r in rows if r.kind == "effect"] == [True] and states[0].spread is None


def test_partitions_take_the_whole_budget(spark):
    cells = spark.createDataFrame([(f"c{i}", i % 2) for i in range(27)], "cell_id string, stratum int")
    out = allocation.partition_cells(cells, "s").collect()
    for stratum, size in ((0, 14), (1, 13)):
        mine = [r for r in out if r.stratum == stratum]
        assert size // 4 * 4 == 12 and len({r.cell_id for r in mine if r.rule == "shared_all_B"}) == 12
        folds = [{r.cell_id for r in mine if r.rule == "crossfit_4" and r.direction == f and r.role == "observation"} for f in range(4)]
        assert [len(f) for f in folds] == [3, 3, 3, 3] and len(set.union(*folds)) == 12
        given = {r.cell_id for r in mine if r.rule == "crossfit_4" and r.direction == 1 and r.role == "input"}
        assert given == set.union(*folds) - folds[1]
    assert len({r.cell_id for r in allocation.partition_cells(cells, "s", 0.5).collect()}) == 8
    assert allocation.partition_cells(cells.where("cell_id in ('c0', 'c1')"), "s").count() == 0


def test_checks_of_means_and_folds(spark):
    members = spark.createDataFrame([("0", 1, "x", 0, "B1", 0), ("0", 1, "y", 0, "B2", 0)], "allocation string, depth int, cell_id string, stratum int, block string, within_block_index int")
    cells = spark.createDataFrame([("x", 0, [1.0, 2.0]), ("y", 0, [3.0, 4.0])], "cell_id string, stratum int, profile array<double>")
    refs = lambda *rows: spark.createDataFrame(rows, "allocation string, depth int, block string, profile array<double>")
    assert quality.membership(members, cells, refs(("0", 1, "B1", [1.0, 2.0]), ("0", 1, "B2", [3.0, 4.0]))).count() == 0
    wrong = quality.membership(members, cells, refs(("0", 1, "B1", [1.0, 2.1]), ("0", 1, "B3", [3.0, 4.0]))).collect()
    assert sorted((r.block, r.reason) for r in wrong) == [("B1", "means"), ("B2", "means"), ("B3", "means")]
    folds = [(f, "observation" if f == own else "input", c) for c, own in (("x", 0), ("y", 1), ("z", 0)) for f in (0, 1)]
    bad = {r.cell_id: r.reason for r in quality.complement_folds(spark.createDataFrame([*folds, (1, "input", "y"), (0, "observation", "w")], "fold int, role string, cell_id string"), spark.createDataFrame([(c,) for c in "xywv"], "cell_id string")).collect()}
    assert bad == {"y": "two_roles", "z": "unknown_cell", "w": "inputs", "v": "held_out"}


def test_cells_without_counts_are_an_error(spark):
    counts = spark.createDataFrame([("a", "g", 3), ("b", "g", 0)], "cell_id string, gene string, cnt int")
    assert profiles.normalize_cp10k(counts.where("cell_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="without counts: b"):
        profiles.normalize_cp10k(counts).collect()


def test_variance_of_large_values(spark):
    v = spark.createDataFrame([("g", 1e9 + i) for i in range(4)], "gene string, value double")
    row = profiles.gene_moments(v, 4).first()
    assert row.variance == pytest.approx(1.25) and profiles.gene_moments(v, 8).first().variance == pytest.approx(np.var([1e9, 1e9 + 1, 1e9 + 2, 1e9 + 3, 0, 0, 0, 0]))


def test_a_query_makes_its_tables_once(spark):
    made = []
    registry.QUERIES.pop("_probe", None)

    @registry.query("_probe")
    def _(spark, d):
        for _ in range(3):
            out = registry.once(("t", d), lambda: made.append(1) or spark.range(1).withColumnRenamed("id", "x"))
        return out

    registry.QUERIES["_probe"](spark, "d")
    registry.QUERIES.pop("_probe")(spark, "d")
    assert len(made) == 2
