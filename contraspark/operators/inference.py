"""Unit-level inference: exact sign tests with Holm, intervals, resampling, model graphs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraspark.operators.prefix import numbered
from contraspark.operators.student import binomial_tail, with_t_quantile
from contraspark.sources.storage import keep

MAX_EXACT = 110


def sign_counts(utilities: DataFrame) -> DataFrame:
    """Wins, losses and ties of each ordered method pair over units; an exact zero is a tie.

    ``missing`` counts the units of the dataset and allocation for which a method of the pair has no
    utility (null, not a number, or no row). One order of each pair is compared and mirrored.
    """
    key = ["dataset_id", "allocation_id"]
    a, b = utilities.alias("a"), utilities.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, "unit_id"]] + [F.col("a.method_id") < F.col("b.method_id")]
    d = F.col("a.utility") - F.col("b.utility")
    d = F.when(~F.isnan(d), d)
    half = a.join(b, on).groupBy(*[f"a.{c}" for c in key], F.col("a.method_id").alias("source"), F.col("b.method_id").alias("target")).agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    both = half.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("_turn"))
    turned = lambda x, y: F.when(F.col("_turn"), F.col(y)).otherwise(F.col(x)).alias(x)
    both = both.select(*key, turned("source", "target"), turned("target", "source"), turned("wins", "losses"), turned("losses", "wins"), "ties")
    units = utilities.groupBy(*key).agg(F.count_distinct("unit_id").alias("_units"))
    return both.join(units, key).withColumn("missing", F.col("_units") - F.col("wins") - F.col("losses") - F.col("ties")).drop("_units")


@lru_cache(1)
def _tails() -> list[tuple[int, int, float]]:
    return [(k, w, sum(math.comb(k, i) for i in range(w, k + 1)) / 2**k) for k in range(MAX_EXACT + 1) for w in range(k + 1)]


def sign_tails(counts: DataFrame) -> DataFrame:
    """p of each direction: P[Bin(wins + losses, 1/2) >= wins], up to 110 trials from a table of exact integer sums, beyond by the
    incomplete beta function in doubles. A comparison with missing units has no p."""
    table = F.broadcast(counts.sparkSession.createDataFrame(_tails(), "trials int, w int, p double"))  # 6,216 rows
    k = (F.col("wins") + F.col("losses")).cast("int")
    j = counts.withColumn("k", k).join(table, (F.col("k") == F.col("trials")) & (F.col("wins") == F.col("w")), "left").drop("trials", "w")
    p = F.when(F.col("k") > MAX_EXACT, binomial_tail(F.col("k"), F.col("wins"))).otherwise(F.col("p"))
    return j.withColumn("p", F.when(F.col("missing") == 0, p) if "missing" in counts.columns else p)


def holm(df: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """Step-down adjusted p: running maximum of p * (m - rank + 1), at most 1. A row without p stays in its family, as if p were 1, and has none."""
    w = Window.partitionBy(*family)
    filled = F.coalesce(F.col(p), F.lit(1.0))
    by = w.orderBy(filled, *order)
    step = df.withColumn("holm_rank", F.row_number().over(by)).withColumn("_raw", filled * (F.count("*").over(w) - F.col("holm_rank") + 1))
    adjusted = F.least(F.lit(1.0), F.max("_raw").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return step.withColumn("adjusted", F.when(F.col(p).isNotNull(), adjusted)).drop("_raw")


def smallest_k(m: Column, alpha: float) -> Column:
    """Fewest trials at which a clean sweep can be significant: 2**-k <= alpha / m."""
    return F.ceil(F.log2(m / F.lit(alpha)) - 1e-12).cast("int")


def directional(df: DataFrame, alpha: float, family: list[str]) -> DataFrame:
    """Decision of each hypothesis, with the reason where it is withheld; the family's size is its number of rows."""
    df = df.withColumn("_m", F.count("*").over(Window.partitionBy(*family)).cast("double"))
    least = smallest_k(F.col("_m"), alpha)
    reason = F.when(F.col("adjusted").isNull(), "missing_units").when(F.col("k") < least, "too_few_untied_units")
    decision = F.when(reason.isNotNull(), "WITHHELD").when(F.col("adjusted") <= alpha, "DIRECTION").otherwise("NO_DIRECTION")
    return df.withColumn("least_k", least).withColumn("decision", decision).withColumn("reason", reason).drop("_m")


@lru_cache(256)
def t_quantile(p: float, df: int) -> float:
    """Student t quantile by bisection on the density's integral over the substituted angle (a scalar for the driver)."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def cdf(t: float) -> float:
        n, top = 2000, math.atan(t / math.sqrt(df))
        h = top / n
        f = lambda x: math.cos(x) ** (df - 1)
        s = f(0) + f(top) + 4 * sum(f(h * i) for i in range(1, n, 2)) + 2 * sum(f(h * i) for i in range(2, n, 2))
        return 0.5 + c * math.sqrt(df) * s * h / 3

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_intervals(df: DataFrame, key: list[str], value: str, quantile: float | None = None, confidence: float = 0.95, family: list[str] | None = None) -> DataFrame:
    """mean +- t * sd / sqrt(n), with t of each row's n - 1 degrees; unassessable with a null value, one unit, or a zero error.

    With ``family`` the intervals of all keys that share these columns hold together (Bonferroni). ``quantile``
    takes the place of t.
    """
    g = df.groupBy(*key).agg(F.count("*").alias("n"), F.count(value).alias("filled"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    if quantile is not None:
        g = g.withColumn("_t", F.lit(quantile))
    else:
        members = F.lit(1) if family is None else F.count("*").over(Window.partitionBy(*family))
        g = with_t_quantile(g.withColumn("_d", F.col("n") - 1), 1 - (1 - confidence) / 2 / members, "_d", "_t")
    whole = F.col("n") == F.col("filled")
    fine = F.coalesce((F.col("se") > 0) & (F.col("se") < float("inf")), F.lit(False))
    reason = F.when(~whole, "missing_unit").when(F.col("n") < 2, "insufficient_units").when(~fine, "zero_or_nonfinite_error")
    known = lambda c: F.when(whole, F.col(c)).alias(c)
    bound = lambda sign: F.when(reason.isNull(), F.col("mean") + sign * F.col("_t") * F.col("se"))
    return g.select(*key, "n", known("mean"), known("se"), bound(-1).alias("lower"), bound(1).alias("upper"), F.when(reason.isNull(), "ok").otherwise("unassessable").alias("status"), reason.alias("reason"))


def hash_int(seed: str, *parts: Column) -> Column:
    """A reproducible non-negative integer below 2**32 from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 8), 16, 10).cast("long")


def schedule(units: DataFrame, unit: str, reps: int, seed: str) -> DataFrame:
    """rep, unit, times: how often each of ``reps`` draws of whole units, with replacement, takes a unit. ``units`` has one row for each."""
    placed = numbered(units.select(F.col(unit).alias("_unit")), ["_unit"], "_place")
    n = placed.agg(F.count("*").alias("_units"))
    slots = placed.select(F.col("_place").alias("_slot")).crossJoin(F.broadcast(n)).select("_slot", "_units", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))  # one row of n
    drawn = slots.select("rep", (hash_int(seed, F.col("rep").cast("string"), F.col("_slot").cast("string")) % F.col("_units")).alias("_place"))
    return drawn.groupBy("rep", "_place").agg(F.count("*").alias("times")).join(placed, "_place").select("rep", F.col("_unit").alias(unit), "times")


def complete(df: DataFrame, key: list[str], unit: str, value: str) -> DataFrame:
    """key, units, whole: whether the key has exactly one finite value for each unit of the table."""
    n = F.broadcast(df.agg(F.count_distinct(unit).alias("units")))  # one row
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    g = df.groupBy(*key).agg(F.count("*").alias("_rows"), F.count_distinct(unit).alias("_own"), F.count_if(finite).alias("_fine")).crossJoin(n)
    return g.select(*key, "units", ((F.col("_rows") == F.col("units")) & (F.col("_own") == F.col("units")) & (F.col("_fine") == F.col("units"))).alias("whole"))


def bootstrap_means(df: DataFrame, key: list[str], unit: str, value: str, reps: int, seed: str) -> DataFrame:
    """key, rep, mean over as many units drawn with replacement; one schedule of draws for all keys.

    A key that lacks a unit's value, or has one that is null or not finite, is unassessable: its means are null.
    """
    times = schedule(df.select(unit).distinct(), unit, reps, seed)
    g = df.join(times, unit).groupBy(*key, "rep").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("_mean"))
    return g.join(complete(df, key, unit, value), key).select(*key, "rep", F.when(F.col("whole"), F.col("_mean")).alias("mean"))


ALL_FLIPS, DRAWN_FLIPS = 12, 4096


def flip_count(n: int) -> int:
    """Sign vectors of n units: all 2**n up to 12 units, 4096 antithetic ones beyond."""
    return 1 << n if n <= ALL_FLIPS else DRAWN_FLIPS


def unit_numbers(df: DataFrame, unit: str) -> DataFrame:
    """Each unit with its place n from 0."""
    return numbered(df.select(unit).distinct(), [unit], "n")


def sign_flips(df: DataFrame, key: list[str], unit_no: str, value: str, n: int, seed: str = "f1") -> DataFrame:
    """|T| of each key under sign vectors of the n units' deviations from the mean, re-studentized.

    Up to 12 units all 2**n vectors are taken. Beyond, 2048 vectors and their negatives: unit 0 keeps its sign, units 1 to 11 take
    all 2**11 combinations, so no two vectors are equal or opposite, and the others' signs are hash bits.
    A vector and its negative have the same |T|, which is computed once for both.
    """
    own = df.withColumn("_dev", F.col(value) - F.avg(value).over(Window.partitionBy(*key))).where(F.col("_dev").isNotNull())
    own = own.groupBy(*key).agg(F.collect_list(F.struct(F.col(unit_no).cast("int").alias("u"), "_dev")).alias("_x"))  # the units of one key
    schema = T.StructType([df.schema[c] for c in key]).add("flip", T.IntegerType()).add("t", T.DoubleType())
    return own.select(*key, F.col("_x.u").alias("_u"), F.col("_x._dev").alias("_d")).mapInArrow(_flipped(len(key), n, seed), schema)


def sign_vectors(n: int, seed: str) -> np.ndarray:
    """[unit, flip] of 1 and -1 (see ``sign_flips``); of antithetic vectors the first half, flip f being opposite to flip DRAWN_FLIPS - 1 - f."""
    flips = np.arange(flip_count(n) // 2 if n > ALL_FLIPS else 1 << n)
    minus = np.zeros((n, len(flips)), bool)
    for u in range(n):
        if n <= ALL_FLIPS:
            minus[u] = flips >> u & 1
        elif 0 < u < ALL_FLIPS:
            minus[u] = flips >> (u - 1) & 1
        elif u:
            minus[u] = [int(hashlib.md5(f"{seed}|{f}|{u}".encode()).hexdigest()[:8], 16) & 1 for f in flips.tolist()]
    return np.where(minus, -1.0, 1.0)


def _flipped(keys: int, n: int, seed: str):
    """|T| of every key of a batch under every sign vector: one matrix product. Signs do not change squares, so each vector's spread follows from its mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = sign_vectors(n, seed)
        flips = np.arange(signs.shape[1], dtype=np.int32)
        if n > ALL_FLIPS:
            flips = np.concatenate([flips, DRAWN_FLIPS - 1 - flips])
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                dev = np.zeros((batch.num_rows, n))
                for row, (u, d) in enumerate(zip(batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist(), strict=True)):
                    dev[row, u] = d
                count = np.array([len(u) for u in batch.column(keys).to_pylist()], float)[:, None]
                square = (dev * dev).sum(1, keepdims=True)
                m = dev @ signs / count
                with np.errstate(divide="ignore", invalid="ignore"):
                    v = (square - count * m * m) / (count - 1)
                    t = np.where((count > 1) & (v > 1e-14 * square), np.abs(m) / np.sqrt(v / count), np.where(np.abs(m) <= 1e-15, 0.0, np.inf))
                if n > ALL_FLIPS:
                    t = np.concatenate([t, t], axis=1)
                which = pa.array(np.repeat(np.arange(batch.num_rows), len(flips)))
                names = [*batch.schema.names[:keys], "flip", "t"]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(which) for i in range(keys)], pa.array(np.tile(flips, batch.num_rows)), pa.array(t.ravel())], names)

    return run


def closure(edges: DataFrame, key: list[str]) -> DataFrame:
    """All (source, target) reachable by directed edges. Each round doubles the paths' length, to the fixpoint, and is written to shared storage."""
    reach = keep(edges.select(*key, "source", "target").distinct(), "closure")
    before = reach.count()
    while True:
        a, b = reach.alias("a"), reach.alias("b")
        more = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key] + [F.col("a.target") == F.col("b.source")]).select(*[f"a.{c}" for c in key], "a.source", "b.target")
        reach = keep(reach.union(more).distinct(), "closure")
        now = reach.count()
        if now == before:
            return reach
        before = now


#: The three decisions on a reported graph.
CYCLIC, ONE_SOURCE, MANY_SOURCES = "ABSTAIN_CYCLIC_REPORTED_GRAPH", "SUPPORTED_SINGLETON_REPORTED_GRAPH_SOURCE", "ABSTAIN_NON_SINGLETON_REPORTED_GRAPH_SOURCE"


def reported_graph(edges: DataFrame, methods: DataFrame, key: list[str]) -> DataFrame:
    """Each method's place in the graph of reported directions (source beats target), methods without edges included.

    beats and beaten_by count direct edges; is_source: beaten by none; condorcet: beats all others directly;
    component: the least name of the methods on a common cycle, null off cycles. lower and upper bound the
    position by all methods above and below; they are null where the graph has a cycle. status is the graph's.
    """
    edges = keep(edges.select(*key, "source", "target").distinct(), "edges")
    reach = closure(edges, key)
    back = reach.select(*key, F.col("target").alias("source"), F.col("source").alias("target"))
    row = lambda df, method, what, other="target": df.select(*key, F.col(method).alias("method"), F.lit(what).alias("what"), F.col(other).alias("other"))
    parts = [
        row(methods.select(*key, "method").distinct(), "method", "roster", "method"), row(edges, "source", "beats"), row(edges, "target", "beaten_by"),
        row(reach, "source", "below"), row(reach, "target", "above"), row(reach.join(back, [*key, "source", "target"]), "source", "cycle"),
    ]
    is_a = lambda what: F.col("what") == what
    counts = [F.count_if(is_a(what)).alias(what) for what in ("beats", "beaten_by", "below", "above")]
    g = reduce(DataFrame.union, parts).groupBy(*key, "method").agg(*counts, F.min(F.when(is_a("cycle"), F.col("other"))).alias("component"))
    graph = Window.partitionBy(*key)
    n, cyclic = F.count("*").over(graph), F.count("component").over(graph) > 0
    status = F.when(cyclic, CYCLIC).when(F.count_if(F.col("beaten_by") == 0).over(graph) == 1, ONE_SOURCE).otherwise(MANY_SOURCES)
    return g.select(
        *key, "method", "beats", "beaten_by", (F.col("beaten_by") == 0).alias("is_source"), (F.col("beats") == n - 1).alias("condorcet"), "component",
        F.when(~cyclic, F.col("above") + 1).alias("lower"), F.when(~cyclic, n - F.col("below")).alias("upper"), status.alias("status"),
    )
