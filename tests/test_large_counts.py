"""Sign tests and intervals of more trials than the tables of exact sums hold."""

import math
from fractions import Fraction

from contraspark.operators import inference, resampling


def test_sign_tails_beyond_the_table(spark):
    counts = [(0, 111), (70, 50), (111, 0), (600, 400), (400, 600), (1000, 1000), (60, 50), (3000, 2000)]
    df = spark.createDataFrame([("f", str(i), w, n) for i, (w, n) in enumerate(counts)], "fam string, source string, wins long, losses long")
    got = {(r["wins"], r["losses"]): r["p"] for r in inference.sign_tails(df).collect()}
    assert len(got) == len(counts)  # pairs of more than 110 units were lost before
    for (w, n), p in got.items():
        want = float(Fraction(sum(math.comb(w + n, i) for i in range(w, w + n + 1)), 2 ** (w + n)))
        assert math.isclose(p, want, rel_tol=1e-9), (w, n)
    holm = {r["source"]: r["adjusted"] for r in inference.holm(inference.sign_tails(df), ["fam"], "p", ["source"]).collect()}
    assert math.isclose(holm["2"], 7 * 2.0**-111, rel_tol=1e-9)  # the second of all eight pairs; 3000 of 5000 come first


def test_clopper_pearson_of_many_trials(spark):
    pairs = [(0, 10), (1, 5), (5, 5), (3, 10), (300, 1000), (30_000, 100_000), (3, 2_000_000)]
    got = {(r.x, r.n): (r.lower, r.upper) for r in resampling.clopper_pearson(spark.createDataFrame(pairs, "x long, n long"), "x", "n").collect()}
    term = lambda k, n, p: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    below = lambda x, n, p: math.fsum(term(k, n, p) for k in range(x + 1))
    for (x, n), (lo, hi) in got.items():
        assert lo == 0 if x == 0 else abs(1 - below(x - 1, n, lo) - 0.025) < 1e-7, (x, n)
        assert hi == 1 if x == n else abs(below(x, n, hi) - 0.025) < 1e-7, (x, n)
    big = resampling.clopper_pearson(spark.createDataFrame([(300_000_000, 1_000_000_000)], "x long, n long"), "x", "n").first()
    width = 2 * 1.959963984540054 * math.sqrt(0.3 * 0.7 / 1e9)
    assert abs((big["upper"] - big["lower"]) / width - 1) < 1e-3


def test_closure_reaches_the_fixpoint(spark):
    # A path of 24 edges: 3 doublings end at 8 edges. And a cycle, whose nodes reach themselves.
    edges = [("p", str(i), str(i + 1)) for i in range(24)] + [("c", "x", "y"), ("c", "y", "x")]
    got = inference.closure(spark.createDataFrame(edges, "fam string, source string, target string"), ["fam"]).collect()
    assert sum(r["fam"] == "p" for r in got) == 25 * 24 // 2
    assert {(r["source"], r["target"]) for r in got if r["fam"] == "c"} == {(a, b) for a in "xy" for b in "xy"}
