"""Operators on small cases whose results are known by hand."""

import pytest
from pyspark.sql import functions as F

from contraspark.operators import allocation, inference, organizer, quality, scoring
from contraspark.sources import storage


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("rule,forwards,unique", [
    ("shared_all_B", 16, 16), ("O_quarter", 4, 4), ("O_half", 8, 8), ("O_three_quarters", 12, 12), ("crossfit_2", 16, 16), ("crossfit_4", 48, 16), ("overlap_half", 8, 8), ("crossfit2_overlap_all", 16, 16),
])
def test_rule_costs_of_sixteen_rows(spark, rule, forwards, unique):
    got = allocation.rule_cost(allocation.rule_partitions(spark, 16).where(F.col("rule") == rule)).first()
    assert (got["forwards"], got["unique_rows"], got["physical_rows"]) == (forwards, unique, 16)
    assert got["uncached_ratio"] == forwards / 16 and got["cached_ratio"] == unique / 16


def test_every_rule_uses_all_rows_and_splits_them_where_it_should(spark):
    parts = {}
    for r in allocation.rule_partitions(spark, 8).collect():
        parts.setdefault((r["rule"], r["direction"]), {}).setdefault(r["role"], set()).add(r["row"])
    assert len(parts) == 13
    for (rule, _), role in parts.items():
        assert role["input"] | role["observation"] == set(range(8))
        if "overlap" not in rule and rule != "shared_all_B":
            assert not role["input"] & role["observation"]
    assert parts["O_quarter", 0] == {"input": {0, 1}, "observation": set(range(2, 8))}
    assert parts["O_three_quarters", 0]["input"] == set(range(6)) and parts["overlap_half", 0]["input"] == set(range(4))
    for budget in (0, -4, 2, 6):
        with pytest.raises(ValueError):
            allocation.rule_partitions(spark, budget)


def test_crossing_labels(spark):
    cases = [
        ("effect", "state", -1.0, 1.0, True, "state_to_effect"), ("effect", "state", 1.0, -1.0, True, "unexpected_reversal"), ("effect", "state", -1.0, 1.0, False, "ranking_reversal"),
        ("effect", "effect", -1.0, 1.0, True, "ranking_reversal"), ("state", "state", 1.0, -1.0, True, "ranking_reversal"), ("effect", "state", 1.0, 2.0, True, "effect_preferred_both"),
        ("effect", "state", -1.0, -2.0, True, "state_preferred_both"), ("state", "state", 1.0, 2.0, True, "a_preferred_both"), ("effect", "effect", -1.0, -2.0, True, "b_preferred_both"), ("effect", "state", 0.0, 2.0, True, "numerical_tie"),
    ]
    df = spark.createDataFrame(cases, "kind_a string, kind_b string, d_s double, d_d double, applicable boolean, want string")
    assert all(r["label"] == r["want"] for r in scoring.crossing(df).collect())


def test_one_gene_identity_and_an_effect_conditioned_on_its_input(spark):
    """Controls -1, 0, 1 and target 0: v = 2, the state loses by v more under disjoint roles; conditioned effects have no identity."""
    s = lambda data, schema: spark.createDataFrame(data, schema)
    blocks = s([("0", 1, f"B{i + 1}", [float(i - 1)]) for i in range(3)], "allocation string, depth int, block string, profile array<double>")
    targets, scales = s([("t", [0.0])], "task string, treated array<double>"), s([([1.0],)], "scale array<double>")
    fixed = s([("t", "e", "effect", [0.0]), ("t", "m", "state", [0.0])], "task string, model string, kind string, prediction array<double>")
    moving = s([("t", "0", 1, f"B{i + 1}", "c", "effect", [float(i)]) for i in range(3)], "task string, allocation string, depth int, input string, model string, kind string, prediction array<double>")
    tuples = scoring.role_tuple_mse(targets, blocks, fixed, scales, moving)
    assert tuples.count() == 81
    got = {(r["model"], r["observation"], r["prediction"], r["input"]): r["mse"] for r in tuples.collect()}
    assert got["e", "B1", "B3", "B2"] == 1.0 and got["m", "B1", "B3", "B2"] == 4.0 and got["c", "B1", "B1", "B3"] == 1.0 and got["c", "B3", "B1", "B3"] == 9.0
    v = scoring.reference_distance(blocks, scales)
    assert abs(v.first()["v"] - 2.0) < 1e-12
    check = {(r["model_a"], r["model_b"]): r for r in scoring.identity_check(scoring.pair_margins(scoring.pattern_mse(tuples)), v).collect()}
    assert check["e", "m"]["holds"] and abs(check["e", "m"]["d_d"] - check["e", "m"]["d_s"] - 2.0) < 1e-12
    assert check["c", "m"]["holds"] is None and not check["c", "m"]["applicable"] and check["c", "e"]["holds"] is None
    role = {(r["model"], r["role"]): r for r in scoring.single_role_contrasts(tuples).collect()}
    assert role["c", "input"]["mean_abs"] > 0 == role["e", "input"]["mean_abs"] and role["c", "input"]["n"] == 54
    assert all(r["n"] == 108 for r in scoring.role_interactions(tuples).collect())


def test_releases_need_geometry_and_lose_no_row(spark):
    anchors = spark.createDataFrame([(c, "u", "A", "1", m, x) for c in ("1", "2", "3") for m, x in (("a", 0.0), ("b", 5.0))], "case_id string, unit string, budget string, realization string, model string, score double")
    shift = spark.createDataFrame([("A", "a", "b", 1.0)], "budget string, model_a string, model_b string, bound double")
    factor = spark.createDataFrame([("A", "a", "b", 2.0, "available")], "budget string, model_a string, model_b string, factor double, reason string")
    geometry = spark.createDataFrame([("1", "A", 1.0), ("2", "A", 0.0)], "case_id string, budget string, geometry double")
    got = {(r["case_id"], r["policy"]): r for r in organizer.release_decisions(anchors, shift, factor, geometry, 0.5).collect()}
    assert len(got) == 9
    assert got["1", "geometry_scaled"]["released"] and got["1", "geometry_scaled"]["limit"] == 2.0 and got["1", "geometry_scaled"]["favoured"] == "a"
    assert not got["2", "geometry_scaled"]["released"] and got["2", "geometry_scaled"]["reason"] == "assessment_geometry_at_or_below_tolerance" and got["2", "geometry_scaled"]["limit"] is None
    assert got["3", "geometry_scaled"]["reason"] == "geometry_not_supplied" and got["3", "repeated_primary"]["released"]
    none = organizer.release_decisions(anchors, shift.limit(0), factor.limit(0), geometry, 0.5)
    assert none.count() == 9 and {r["policy"] for r in none.where("released").collect()} == {"single_split"}
    higher = organizer.release_decisions(anchors, shift, factor, geometry, 0.5, lower_is_better=False)
    assert {r["favoured"] for r in higher.collect()} == {"b"}
    near = organizer.release_decisions(anchors.withColumn("score", F.col("score") * 1e-14), shift, factor, geometry, 0.0)
    assert all(r["favoured"] is None for r in near.collect())


def test_geometry_reasons(spark):
    scores = spark.createDataFrame(
        [(c, "u", b, r, m, float(x)) for b in "ABC" for c in "12" for r, m, x in (("1", "a", 0), ("1", "b", 1), ("2", "a", 0), ("2", "b", 3))],
        "case_id string, unit string, budget string, realization string, model string, score double",
    )
    geometry = spark.createDataFrame([("1", "A", 4.0), ("2", "A", 1.0), ("1", "B", 1.0), ("2", "B", 0.0), ("1", "C", 1.0)], "case_id string, budget string, geometry double")
    got = {r["budget"]: (r["factor"], r["reason"]) for r in organizer.calibrate_geometry(scores, geometry).collect()}
    assert got == {"A": (2.0, "available"), "B": (None, "development_zero_geometry_shift"), "C": (None, "geometry_not_supplied")}


def test_checks_see_nulls_and_absent_partners(spark):
    s = lambda data, schema: spark.createDataFrame(data, schema)
    table = s([(1, "x"), (1, None), (2, "y"), (2, "y"), (3, None)], "k int, v string")
    assert rows(quality.functional_dependency(table, "k", "v"), "k") == [(1,)]
    one = s([("d", "a", "b", 3, 1), ("d", "b", "a", 1, 3), ("d", "a", "c", 2, 2)], "g string, source string, target string, wins int, losses int")
    assert rows(quality.pair_symmetry(one, ["g"]), "source", "target") == [("a", "c")]
    a, b = s([(1, 1.0), (2, None), (3, None), (4, 1.0)], "k int, v double"), s([(1, 1.0), (2, 2.0), (3, None), (5, 1.0)], "k int, v double")
    assert rows(quality.table_equivalence(a, b, ["k"], "v"), "k", "reason") == [(2, "value"), (4, "only first"), (5, "only second")]
    pools = s([(x, "R", "0", 1, r, c) for x, r, c in (("shared", "input", "1"), ("shared", "observation", "2"), ("split", "input", "1"), ("split", "observation", "2"), ("split", "prediction", "1"))], "scheme string, rotation string, allocation string, depth int, role string, cell_id string")
    got = {(r["scheme"], r["role_a"], r["role_b"]): (r["shared"], r["allowed"]) for r in quality.role_pools(pools).collect()}
    assert got == {("shared", "input", "observation"): (0, False), ("split", "input", "observation"): (0, True), ("split", "input", "prediction"): (1, False), ("split", "observation", "prediction"): (0, True)}


def test_fingerprints_tell_nulls_empty_texts_and_separators_apart(spark):
    of = lambda *x: tuple(storage.table_fingerprint(spark.createDataFrame(list(x), "a string, b string"), ["a", "b"]).first())
    prints = [of(("x", None)), of(("x", "")), of(("x|", "y")), of(("x", "|y")), of(("1:x", "y")), of(("x", "y"), ("x", "y"))]
    assert len(set(prints)) == len(prints) and of(("a", "b"), ("c", "d")) == of(("c", "d"), ("a", "b"))


def test_short_strata_are_refused(spark):
    cells = spark.createDataFrame([(str(i), i % 2) for i in range(9)], "cell_id string, stratum int")
    assert allocation.allocate_blocks(cells, 2, (1, 2), 1, "s").where("depth = 2").count() == 8
    with pytest.raises(ValueError, match="too few"):
        allocation.allocate_blocks(cells, 3, (1, 2), 1, "s")


def test_large_families_keep_their_pairs(spark):
    counts = spark.createDataFrame([("d", "x", "a", "b", 150, 50, 0)], "dataset_id string, allocation_id string, source string, target string, wins long, losses long, ties long")
    got = inference.sign_tails(counts).collect()
    assert len(got) == 1 and 0 < got[0]["p"] < 1e-11


def test_graph_of_reported_directions(spark):
    """a chain with a lone method, a cycle, a winner over all, and no edge at all."""
    edges = spark.createDataFrame([("chain", *e) for e in ("ab", "bc")] + [("cycle", *e) for e in ("ab", "bc", "ca", "cd")] + [("winner", *e) for e in ("ba", "bc", "bd")], "g string, source string, target string")
    methods = spark.createDataFrame([(g, m) for g in ("chain", "cycle", "winner", "none") for m in "abcd"], "g string, method string")
    got = {(r["g"], r["method"]): r for r in inference.reported_graph(edges, methods, ["g"]).collect()}
    assert len(got) == 16
    bounds = lambda g: [(got[g, m]["lower"], got[g, m]["upper"]) for m in "abcd"]
    assert bounds("chain") == [(1, 2), (2, 3), (3, 4), (1, 4)] and bounds("none") == [(1, 4)] * 4
    assert bounds("winner") == [(2, 4), (1, 1), (2, 4), (2, 4)] and bounds("cycle") == [(None, None)] * 4
    assert [got["cycle", m]["component"] for m in "abcd"] == ["a", "a", "a", None]
    assert [m for m in "abcd" if got["chain", m]["is_source"]] == ["a", "d"] and [k for k, r in got.items() if r["condorcet"]] == [("winner", "b")]
    assert {g: got[g, "a"]["status"] for g in ("chain", "cycle", "winner", "none")} == {
        "chain": inference.MANY_SOURCES, "none": inference.MANY_SOURCES, "cycle": inference.CYCLIC, "winner": inference.ONE_SOURCE,
    }
