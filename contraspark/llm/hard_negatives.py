"""Hard negatives by exact integer scores, computed as matrix products modulo small primes.

Vectors of integers are reduced modulo several primes below 1024. With residues around zero, a product of
64 components and their sum stay below 2**24, so float32 matrix products are exact; longer vectors are
multiplied in stretches of 64. The exact signed score follows from its residues by Chinese remaindering,
digit by digit in a mixed radix around zero. As many primes are taken as the largest possible score needs.

The anchors are held against all rows in blocks: each block of anchors meets each block of rows in one
group, as float32 work of ``anchor_block`` x ``row_block`` scores in tiles. The first pass keeps for each
anchor the best rows of its own label, the second the best rows of other labels inside the window that
each of these positives sets; both keep a few rows of each pair of blocks and rank those by a window
function. Scores are computed twice, but no score leaves its group.

Defined cases: rows with a null id, label or vector, with null or non-finite components, or with another
number of components than ``dim`` (by default that of most rows) take no part. Rows are told apart by
place, not by id: rows with equal ids, equal rows too, are candidates and anchors of their own. Equal
scores: the smaller id first. Zero vectors take part. An anchor without another row of its label, or a
positive without a row in its window, gives no rows; an empty table gives none. Scores that may not fit 64
bits are refused with an error. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraspark.llm.common import materialise

POSITIVES, NEGATIVES = 5, 3
ANCHOR_BLOCK, ROW_BLOCK = 8192, 8192
#: Scores that are held at once inside a group.
TILE = 1 << 21
#: Components that one float32 product may sum: 64 * 511**2 < 2**24.
STRETCH, PRIME_LIMIT = 64, 1024
_NONE = np.iinfo(np.int64).min


@lru_cache(1)
def primes() -> list[int]:
    """Primes below PRIME_LIMIT, the largest first."""
    return [p for p in range(PRIME_LIMIT - 1, 2, -2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2))]


def moduli(bound: int) -> list[int]:
    """The largest primes whose product exceeds twice ``bound``."""
    chosen, product = [], 1
    while product <= 2 * bound:
        chosen.append(primes()[len(chosen)])
        product *= chosen[-1]
    return chosen


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2."""
    return (x + p // 2) % p - p // 2


def residues(x: np.ndarray, bases: list[int]) -> list[np.ndarray]:
    """A float32 matrix of residues for each prime."""
    return [_centred(x, p).astype(np.float32) for p in bases]


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p; float32 holds every stretch exactly."""
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], STRETCH):
        out += _centred(np.rint(a[:, at : at + STRETCH] @ b[:, at : at + STRETCH].T).astype(np.int64), p)
    return _centred(out, p)


def scores(a: list[np.ndarray], b: list[np.ndarray], bases: list[int]) -> np.ndarray:
    """Exact inner products of all rows of a with all of b, from their residues."""
    total, radix, digits = None, 1, []
    for i, p in enumerate(bases):
        r = _product(a[i], b[i], p)
        # What the digits found so far leave of this residue, divided by their radix modulo p.
        rest, weight = r, 1
        for d, q in zip(digits, bases, strict=False):
            rest = rest - d * (weight % p)
            weight *= q
        digit = _centred(_centred(rest, p) * pow(radix, -1, p), p)
        digits.append(digit)
        total = digit.copy() if total is None else total + digit * np.int64(radix)
        radix *= p
    return total


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["vector"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), len(column[0]))


def _best(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, rank and column of the k largest entries of each row that are not _NONE; of equal ones the first. Overwrites ``values``."""
    rows, ranks, cols, every = [], [], [], np.arange(len(values))
    for rank in range(min(k, values.shape[1])):
        col = values.argmax(1)
        some = values[every, col] != _NONE
        if not some.any():
            break
        rows.append(every[some])
        ranks.append(np.full(some.sum(), rank))
        cols.append(col[some])
        values[every, col] = _NONE
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(rows), join(ranks), join(cols)


def _tiles(anchors: pa.Table, rows: pa.Table, bases: list[int]):
    """The anchors' places in their table and the scores of these against all rows, which ascend by id."""
    order = np.lexsort((rows["row"].to_numpy(), rows["id"].to_numpy()))
    rows = rows.take(pa.array(order))
    b, a = residues(_matrix(rows), bases), residues(_matrix(anchors), bases)
    step = max(1, TILE // max(1, rows.num_rows))
    for at in range(0, anchors.num_rows, step):
        yield rows, slice(at, at + step), scores([x[at : at + step] for x in a], b, bases)


def _positives(bases: list[int], k: int):
    """The k best rows of its own label for each anchor of a block among the rows of a block."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"anchor": [], "positive_id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            own, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
            for sorted_rows, at, s in _tiles(anchors, rows, bases):
                fits = (label[at, None] == sorted_rows["label"].to_numpy()[None]) & (own[at, None] != sorted_rows["row"].to_numpy()[None])
                r, _, c = _best(np.where(fits, s, _NONE), k)
                out["anchor"].append(own[at][r])
                out["positive_id"].append(sorted_rows["id"].to_numpy()[c])
                out["score"].append(s[r, c])
        return pa.table({n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()})

    return run


def _negatives(bases: list[int], k: int):
    """For each anchor of a block and each window of it the k best rows of other labels among the rows of a block."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"anchor": [], "nth": [], "negative_id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            own, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
            low, high = ([x or [] for x in anchors[n].to_pylist()] for n in ("low", "high"))
            most = max(map(len, low))
            # Windows that an anchor lacks are empty.
            fill = lambda lists, gap: np.array([x + [gap] * (most - len(x)) for x in lists], np.int64).reshape(len(lists), most)
            low, high = fill(low, 1), fill(high, 0)
            for sorted_rows, at, s in _tiles(anchors, rows, bases):
                other = label[at, None] != sorted_rows["label"].to_numpy()[None]
                for nth in range(most):
                    fits = other & (s >= low[at, nth, None]) & (s <= high[at, nth, None])
                    r, _, c = _best(np.where(fits, s, _NONE), k)
                    out["anchor"].append(own[at][r])
                    out["nth"].append(np.full(len(r), nth))
                    out["negative_id"].append(sorted_rows["id"].to_numpy()[c])
                    out["score"].append(s[r, c])
        return pa.table({n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()})

    return run


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vector: Column, scale: int = 256) -> Column:
    """Each component x as the integer floor(scale * x), x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = 50, high: int = 95, scale: int = 256, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, dim: int | None = None) -> DataFrame:
    """anchor_id, positive_id, positive_score, positive_rank, rank, negative_id, negative_score.

    For each row where ``is_anchor`` holds and each of its ``positives`` best other rows of the same label:
    the ``negatives`` best rows of other labels with low * p <= 100 * score <= high * p, p being the
    positive's score. A score is the inner product of the ``quantised`` vectors.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, positive_score long, positive_rank int, rank int, negative_id long, negative_score long")
    usable = F.col(id_col).isNotNull() & label.isNotNull() & _finite(F.col(vector_col))
    rows = vectors.where(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col(vector_col).alias("x"),
    )
    if dim is None:
        common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if common is None:
            return empty
        dim = common[0]
    rows = rows.where(F.size("x") == dim)
    top = rows.agg(F.max(F.coalesce(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))), F.lit(0.0)))).first()[0]
    if top is None:
        return empty
    largest = math.ceil(scale * top) + 1 if math.isfinite(scale * top) else math.inf
    if dim * largest * largest >= 1 << 62:
        raise ValueError(f"scores of {dim} components up to {largest} may not fit 64 bits")
    bases = moduli(max(1, dim * largest * largest))
    kind = "array<int>" if largest < 1 << 31 else "array<long>"
    rows = materialise(rows.select("row", "id", "label", "anchor", quantised(F.col("x"), scale).cast(kind).alias("vector")), "quantised")

    counts = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    if not counts["a"]:
        return empty
    of_rows, of_anchors = (max(1, math.ceil(n / size)) for n, size in ((counts["n"], row_block), (counts["a"], anchor_block)))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("row", "id", "label", "vector", own(of_rows).alias("rb"), every(of_anchors).alias("ab"))
    asked = rows.where("anchor").select("row", "label", "vector", own(of_anchors).alias("ab"))

    def met(anchors: DataFrame, run, schema: str) -> DataFrame:
        # Columns of its own: both sides come from one table.
        anchors = anchors.select(*[F.col(c).alias(c, metadata={}) for c in anchors.columns]).withColumn("rb", every(of_rows))
        return anchors.groupBy("ab", "rb").cogroup(candidates.groupBy("ab", "rb")).applyInArrow(run, schema)

    found = met(asked, _positives(bases, positives), "anchor long, positive_id long, score long")
    best = lambda part, other: F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("score"), other))
    found = found.withColumn("nth", (best(["anchor"], "positive_id") - 1).cast("long")).where(F.col("nth") < positives)
    found = materialise(found, "positives")
    # 100 * s between low * p and high * p, as whole numbers.
    part = lambda percent: F.col("score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    bounds = found.select("anchor", "nth", F.ceil(part(low)).cast("long").alias("lo"), F.floor(part(high)).cast("long").alias("hi"))
    windows = bounds.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "lo", "hi"))).alias("w"))
    windows = windows.select("anchor", F.col("w.lo").alias("low"), F.col("w.hi").alias("high"))
    sought = asked.join(windows, F.col("row") == F.col("anchor")).select("row", "label", "vector", "ab", "low", "high")
    out = met(sought, _negatives(bases, negatives), "anchor long, nth long, negative_id long, score long")
    out = out.withColumn("rank", best(["anchor", "nth"], "negative_id")).where(F.col("rank") <= negatives)
    out = out.withColumnRenamed("score", "negative_score").join(found.withColumnRenamed("score", "positive_score"), ["anchor", "nth"])
    out = out.join(rows.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "positive_score", (F.col("nth") + 1).cast("int").alias("positive_rank"), F.col("rank").cast("int").alias("rank"), "negative_id", "negative_score")
