"""Approximate nearest neighbours with a forest of random-projection trees.

All nodes of one level of a tree share a random direction; a node cuts at a threshold on it. A tree has
as many levels as give leaves of about ``leaf`` vectors, so leaves stay as they are while the table
grows and a path is a number of that many bits. Fit: on a sample of at most ``sample`` distinct vectors
(those with the smallest hashes) a node's threshold is the median of its sampled vectors, as long as it
has ``LEAST_SAMPLED`` of them; deeper nodes cut at the median of all sampled vectors, one number a
level. The forest so has at most ``trees * 2 * sample / LEAST_SAMPLED`` thresholds, whatever the table
holds, and is broadcast. Index: every vector is routed to one leaf of each tree.

Search: a query walks all trees with one shared priority queue. A path's priority is the sum of the
squared margins at which it left the query's own side; the best leaves of the forest are taken. Their
number grows with the table: ``probes`` at 50,000 vectors, and as the power ``probe_power`` of the
vectors beyond, so the scanned share falls. The candidates in these leaves are reranked exactly: cosine
in double precision, added up component by component, so equal vectors always get equal scores.

Vectors are unit-scaled for the trees. Equal vectors count once in the index, with their smallest ids
(one more than the neighbours asked for, enough for any answer), so a vector that a third of the rows
share is one candidate. A leaf of more than ``block`` vectors, which clusters narrower than the sample
shows can make, is searched in blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite components, take no part, as
queries or as candidates; nor do rows with a null id or with another number of components than
``dim`` (by default that of most sampled vectors). With fewer candidates than asked for, all found are
returned. Repeated ids are rows of their own as candidates; a query leaves out all rows of its own id.
Equal scores: the smaller vec_id comes first. Vectors of any length are used whole. Other columns,
whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraspark.llm.common import attach, materialise

K = 5
TREES, LEAF, SAMPLE, PROBES, BLOCK = 12, 200, 16384, 250, 4096
#: A threshold of its own needs so many sampled vectors in its node.
LEAST_SAMPLED = 64
PROBE_POWER, PROBES_AT = 0.4, 50_000
_TREE_SHIFT = 48


@dataclass
class Forest:
    """Directions [tree, level, dim]; thresholds[tree][level]: one for each node, or one for all."""

    planes: np.ndarray
    cuts: list[list[np.ndarray]]

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """[vector, tree] -> leaf: the tree above, the path's sides below."""
        out = np.empty((len(unit), len(self.cuts)), np.int64)
        for t, cuts in enumerate(self.cuts):
            path = np.zeros(len(unit), np.int64)
            # Products of row with direction, added up in one order: a vector takes the same path in any batch.
            side = np.einsum("ij,kj->ik", unit, self.planes[t])
            for level, cut in enumerate(cuts):
                path = path * 2 + (side[:, level] >= cut[path if len(cut) > 1 else 0])
            out[:, t] = path | t << _TREE_SHIFT
        return out

    def probe(self, unit: np.ndarray, probes: int) -> list[int]:
        """Leaves for one query, best first, from one queue over all trees."""
        side = (self.planes @ unit).tolist()
        queue = [(0.0, t, 0, 0) for t in range(len(self.cuts))]
        found = []
        while queue and len(found) < probes:
            priority, t, level, path = heapq.heappop(queue)
            for cut in self.cuts[t][level:]:
                margin = side[t][level] - cut[path if len(cut) > 1 else 0]
                level, near = level + 1, path * 2 + (margin >= 0)
                heapq.heappush(queue, (priority + margin * margin, t, level, near ^ 1))
                path = near
            found.append(path | t << _TREE_SHIFT)
        return found


def fit_forest(unit: np.ndarray, levels: int, trees: int = TREES, least: int = LEAST_SAMPLED, seed: int = 3) -> Forest:
    """Trees of ``levels`` levels on the sampled vectors."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((trees, levels, unit.shape[1]))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    forest = Forest(planes, [])
    for t in range(trees):
        path, cuts = np.zeros(len(unit), np.int64), []
        for level in range(levels):
            side = unit @ planes[t, level]
            if len(unit) >> level >= least:
                order = np.lexsort((side, path))
                count = np.bincount(path, minlength=1 << level)
                middle = np.minimum(np.cumsum(count) - count + count // 2, len(unit) - 1)
                cut = np.where(count > 0, side[order][middle], np.median(side))
            else:
                cut = np.array([np.median(side)])
            cuts.append(cut)
            path = path * 2 + (side >= cut[path if len(cut) > 1 else 0])
        forest.cuts.append(cuts)
    return forest


def probes_for(vectors: int, probes: int = PROBES, power: float = PROBE_POWER) -> int:
    """Leaves to search in a table of so many vectors."""
    return math.ceil(probes * max(1.0, vectors / PROBES_AT) ** power)


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of row pairs: sums in double precision, component by component from the first."""
    dot, nq, nc = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for d in range(q.shape[1]):
        dot += q[:, d] * c[:, d]
        nq += q[:, d] * q[:, d]
        nc += c[:, d] * c[:, d]
    return dot / (np.sqrt(nq) * np.sqrt(nc))


def _rerank(k: int):
    """Rows of a leaf's queries and candidates, sorted by leaf block: the k best candidates of each query."""

    def best(rows: list[tuple]) -> list[tuple]:
        queries, candidates = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not queries or not candidates:
            return []
        q, c = np.array([r[2] for r in queries], np.float64), np.array([r[2] for r in candidates], np.float64)
        near, take = _unit(q) @ _unit(c).T, min(len(candidates), k + 8)
        out = []
        # A shortlist by the matrix product, with all within rounding of its last place, is scored exactly.
        least = np.partition(near, len(candidates) - take, axis=1)[:, len(candidates) - take] - 1e-12
        row, col = np.nonzero(near >= least[:, None])
        exact = _scores(q[row], c[col])
        ids = np.array([r[1] for r in candidates])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        for i, j, s in zip(row[rank < k].tolist(), col[rank < k].tolist(), exact[rank < k].tolist(), strict=True):
            out.append((queries[i][1], candidates[j][1], s))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "c", "score"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leaf", "part", "query", "vid", "vector")]
            for leaf, part, *row in zip(*columns, strict=True):
                if (leaf, part) != key:
                    if done := best(held):
                        yield batch_of(done)
                    key, held = (leaf, part), []
                held.append(tuple(row))
        if done := best(held):
            yield batch_of(done)

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, probes: int = PROBES, probe_power: float = PROBE_POWER, block: int = BLOCK, dim: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all other rows of each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("query")).where(F.col("id").isNotNull() & _usable(F.col("vector")))
    if dim is None:
        sizes = rows.orderBy(F.xxhash64("id"), "id").limit(1000).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if sizes is None:
            return empty
        dim = sizes[0]
    rows = rows.where(F.size("vector") == dim)

    # One row for each different vector, named by its smallest id, with enough ids for any answer.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.select("id", "vector").withColumn("nth", first).where(F.col("nth") <= k + 1)
    classes = few.groupBy("vector").agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialise(classes.join(rows.groupBy(F.col("vector").alias("_v")).agg(F.count("*").alias("rows")), F.col("vector") == F.col("_v")).drop("_v"), "vectors")
    asked = rows.where(F.coalesce("query", F.lit(False))).select("id", "vector")
    asked = materialise(attach(asked, classes.select("vector", "vid", "rows"), ["vector"], F.col("id"), rows="rows").select("id", "vid").distinct(), "queries")

    chosen = classes.orderBy(F.xxhash64("vid"), "vid").select("vector").limit(sample).toArrow()
    if not chosen.num_rows:
        return empty
    n = classes.count()
    levels, wanted = max(0, math.ceil(math.log2(n / leaf))) if n else 0, probes_for(n, probes, probe_power)
    forest = spark.sparkContext.broadcast(fit_forest(_unit(_matrix(chosen.column("vector").combine_chunks())), levels, trees))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.value.leaves(_unit(_matrix(batch.column(1))))
            at = np.repeat(np.arange(batch.num_rows), found.shape[1])
            yield pa.record_batch([pa.array(found.ravel()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["leaf", "vid", "vector"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1)))
            found = [forest.value.probe(u, wanted) for u in unit]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.record_batch([pa.array([x for f in found for x in f], pa.int64()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["leaf", "vid", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    schema = f"leaf long, vid long, vector {kind}"
    indexed = classes.select("vid", "vector").mapInArrow(index, schema)
    seekers = classes.join(asked.select("vid").distinct(), "vid", "left_semi").select("vid", "vector").mapInArrow(search, schema)
    place_of = materialise(classes.select("vid", "vector").mapInArrow(index, schema).groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > block), "large-leaves")
    if place_of.isEmpty():
        split = lambda df: df.withColumn("parts", F.lit(1))
    else:
        split = lambda df: df.join(place_of.select("leaf", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("p")), "leaf", "left").withColumn("parts", F.coalesce("p", F.lit(1)))
    c = split(indexed).select("leaf", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("query"), "vid", "vector")
    q = split(seekers).select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("query"), "vid", "vector")
    pairs = c.union(q).repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(_rerank(k + 1), "q long, c long, score double")

    # A pair found in several trees has one score. The k + 1 best vectors of a query hold its k best rows.
    pairs = pairs.groupBy("q", "c").agg(F.max("score").alias("score"))
    pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("nth") <= k + 1)
    rows_of = pairs.join(classes.select(F.col("vid").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    top = rows_of.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    answers = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    answers = answers.withColumnRenamed("q", "vid").join(asked.groupBy("vid").agg(F.count("*").alias("rows")), "vid")
    out = attach(asked, materialise(answers, "answers"), ["vid"], F.col("id"), rows="rows")
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(mine).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
