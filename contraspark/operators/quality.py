"""Constraint checks; each returns the rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def functional_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values; null is a value of its own."""
    own = df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("known"), F.count("*").alias("n"))
    return own.where("least <> most or (known > 0 and known < n)").select(key, "least", "most")


def complete_support(df: DataFrame, dims: list[str]) -> DataFrame:
    """Combinations of the dimensions' values that have no row. The dimension lists are small roster tables."""
    full = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [df.select(d).distinct() for d in dims])
    return full.join(df.select(*dims).distinct(), dims, "left_anti")


def support_sets(df: DataFrame, group: list[str], member: str) -> DataFrame:
    """Each group's set of members and whether all groups have the same."""
    own = df.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_set(member)), ",").alias("members"))
    same = own.agg((F.min("members") == F.max("members")).alias("equal"))
    return own.crossJoin(F.broadcast(same))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both partitions."""
    return a.select(key).intersect(b.select(key))


def partition_leak(df: DataFrame, key: str, partition: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(partition).alias("partitions")).where("partitions > 1")


def not_finite(df: DataFrame, value: str, least: float | None = None) -> DataFrame:
    c = F.col(value).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.where(bad if least is None else bad | (c < least))


def anchor_equal(assessment: DataFrame, anchors: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Anchor rows whose value differs in the assessment, or that it lacks."""
    a = assessment.select(*keys, F.col(value).alias("assessed"))
    return anchors.join(a, keys, "left").where(~F.col(value).eqNullSafe(F.col("assessed"))).select(*keys, value, "assessed")


def membership(members: DataFrame, cells: DataFrame, references: DataFrame | None = None, rtol: float = 1e-10) -> DataFrame:
    """allocation, depth, block, stratum and reason: unknown cells, other strata, cells used twice, ranks with gaps.

    With ``references`` (allocation, depth, block, profile) also blocks whose cells' mean profile is another, has another
    length, or that one side alone has (reason means, without a stratum); ``cells`` then have profiles.
    """
    key = ["allocation", "depth"]
    joined = members.join(cells.select("cell_id", F.col("stratum").alias("known")), "cell_id", "left")
    wrong = joined.where(~F.col("stratum").eqNullSafe(F.col("known"))).select(*key, "block", "stratum", F.lit("stratum").alias("reason"))
    twice = members.groupBy(*key, "cell_id").agg(F.count("*").alias("n"), F.min("block").alias("block"), F.min("stratum").alias("stratum"))
    twice = twice.where("n > 1").select(*key, "block", "stratum", F.lit("used twice").alias("reason"))
    ranks = members.groupBy(*key, "block", "stratum").agg(F.min("within_block_index").alias("lo"), F.max("within_block_index").alias("hi"), F.count_distinct("within_block_index").alias("n"))
    gaps = ranks.where((F.col("lo") != 0) | (F.col("hi") != F.col("depth") - 1) | (F.col("n") != F.col("depth"))).select(*key, "block", "stratum", F.lit("ranks").alias("reason"))
    out = wrong.union(twice).union(gaps)
    if references is None:
        return out
    block = [*key, "block"]
    long = members.join(cells.select("cell_id", "profile"), "cell_id").select(*block, F.posexplode("profile").alias("gene", "value"))
    made = long.groupBy(*block, "gene").agg(F.avg("value").alias("made"))
    given = references.select(*block, F.posexplode("profile").alias("gene", "given"))
    far = F.coalesce(F.abs(F.col("made") - F.col("given")) > rtol * F.greatest(F.abs("made"), F.abs("given")), F.lit(True))
    kind = members.schema["stratum"].dataType
    return out.union(made.join(given, [*block, "gene"], "full").where(far).select(*block, F.lit(None).cast(kind).alias("stratum"), F.lit("means").alias("reason")).distinct())


def role_pools(pools: DataFrame) -> DataFrame:
    """One row per scheme, rotation, allocation, depth and pair of its roles: cells of each, shared ones, and whether that is allowed.

    Shared roles must hold the same cells, roles of the other schemes none in common. A pair without any
    common cell has a row too.
    """
    key = ["scheme", "rotation", "allocation", "depth"]
    cells = pools.groupBy(*key, "cell_id").agg(F.collect_set("role").alias("roles"))  # as many as a scheme has roles
    size = pools.groupBy(*key, "role").agg(F.count_distinct("cell_id").alias("pool"))
    a, b = size.alias("a"), size.alias("b")
    pairs = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key] + [F.col("a.role") < F.col("b.role")])
    pairs = pairs.select(*[f"a.{c}" for c in key], F.col("a.role").alias("role_a"), F.col("b.role").alias("role_b"), F.col("a.pool").alias("pool_a"), F.col("b.pool").alias("pool_b"))
    both = cells.select(*key, F.explode("roles").alias("role_a"), "roles").select(*key, "role_a", F.explode("roles").alias("role_b")).where("role_a < role_b")
    shared = both.groupBy(*key, "role_a", "role_b").agg(F.count("*").alias("shared"))
    j = pairs.join(shared, [*key, "role_a", "role_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    same = (F.col("shared") == F.col("pool_a")) & (F.col("shared") == F.col("pool_b"))
    return j.withColumn("allowed", F.when(F.col("scheme") == "shared", same).otherwise(F.col("shared") == 0))


def constant_columns(df: DataFrame, required: dict[str, object]) -> DataFrame:
    """Rows where a column does not have its required constant."""
    bad = [~F.col(c).eqNullSafe(F.lit(v)) for c, v in required.items()]
    return df.where(reduce(Column.__or__, bad))


def complement_folds(folds: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that break the folds (fold, role, cell_id): each cell is observed in one fold and the input of all others.

    cell_id, held_out, inputs, reason: unknown_cell, held_out (not in one fold), two_roles (in one fold), inputs (not
    the complement of its observation).
    """
    n = F.broadcast(folds.agg(F.count_distinct("fold").alias("_folds")))  # one row
    each = folds.groupBy("cell_id", "fold").agg(F.count_if(F.col("role") == "observation").alias("_o"), F.count_if(F.col("role") == "input").alias("_i"))
    per = each.groupBy("cell_id").agg(F.sum("_o").alias("held_out"), F.sum("_i").alias("inputs"), F.bool_or(F.col("_o") + F.col("_i") > 1).alias("_two"))
    j = per.join(cells.select("cell_id", F.lit(True).alias("_known")), "cell_id", "full").crossJoin(n)
    j = j.withColumn("held_out", F.coalesce("held_out", F.lit(0))).withColumn("inputs", F.coalesce("inputs", F.lit(0)))
    reason = (
        F.when(F.col("_known").isNull(), "unknown_cell").when(F.col("held_out") != 1, "held_out").when(F.col("_two"), "two_roles").when(F.col("inputs") != F.col("_folds") - 1, "inputs")
    )
    return j.withColumn("reason", reason).where("reason is not null").select("cell_id", "held_out", "inputs", "reason")


def pair_symmetry(counts: DataFrame, key: list[str]) -> DataFrame:
    """Directions (within each key) whose opposite is absent or does not have wins and losses swapped."""
    back = counts.select(*key, F.col("source").alias("target"), F.col("target").alias("source"), F.col("wins").alias("back_losses"), F.col("losses").alias("back_wins"))
    same = F.col("wins").eqNullSafe(F.col("back_wins")) & F.col("losses").eqNullSafe(F.col("back_losses"))
    return counts.join(back, [*key, "source", "target"], "left").where(~same)


def table_equivalence(a: DataFrame, b: DataFrame, keys: list[str], value: str, atol: float = 1e-12, rtol: float = 0.0) -> DataFrame:
    """Keys of one table alone, and values further apart than atol + rtol * |b|."""
    b = b.select(*keys, F.col(value).alias("other"), F.lit(1).alias("in_b"))
    j = a.select(*keys, value, F.lit(1).alias("in_a")).join(b, keys, "full")
    # A null equals a null alone.
    far = F.coalesce(F.abs(F.col(value) - F.col("other")) > atol + rtol * F.abs("other"), F.col(value).isNull() != F.col("other").isNull())
    reason = F.when(F.col("in_a").isNull(), "only second").when(F.col("in_b").isNull(), "only first").when(far, "value")
    return j.withColumn("reason", reason).where("reason is not null").select(*keys, value, "other", "reason")
