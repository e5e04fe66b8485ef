"""Splits, folds and reference allocation by SHA-256 ranks: independent of row order, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contraspark.operators.prefix import running

SCHEMES = [("shared", "SHARED", None), ("split", "SPLIT", 0), ("crossfit", "ROT0", 0), ("crossfit", "ROT1", 1), ("crossfit", "ROT2", 2)]


def hash_rank(seed, *parts) -> object:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def hash_split(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """half: train for the first floor(n / 2) by rank of each group, else target."""
    r = running(df, [group], [hash_rank(f"{seed}|split", key), key], rank="_rank", total="_n")
    return r.withColumn("half", F.when(F.col("_rank") <= F.floor(F.col("_n") / 2), "train").otherwise("target")).drop("_rank", "_n")


def hash_folds(df: DataFrame, key: str, folds: int, seed: str, group: str | None = None) -> DataFrame:
    """fold: rank mod n. Ranks are taken within the group; without one, over all rows."""
    r = running(df, [group] if group else [], [hash_rank(f"{seed}|fold", key), key], rank="_rank")
    return r.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def ranked(cells: DataFrame, allocations: int, seed: str, most: int | None = None) -> DataFrame:
    """One row per cell and allocation with r, its rank in the stratum from 0.

    With ``most`` only the first ranks are returned; the filter is on the rank itself, so tasks drop
    other cells before their shuffle.
    """
    each = cells.select("cell_id", "stratum", F.explode(F.array(*[F.lit(str(a)) for a in range(allocations)])).alias("allocation"))
    w = Window.partitionBy("allocation", "stratum").orderBy(hash_rank(seed, "allocation", "cell_id"), "cell_id")
    each = each.withColumn("n", F.row_number().over(w))
    return (each if most is None else each.where(F.col("n") <= most)).withColumn("r", F.col("n") - 1).drop("n")


def _at_depths(df: DataFrame, depths: tuple[int, ...], within: str) -> DataFrame:
    """Nested depths: a depth takes the cells whose index in the block is below it."""
    return df.select("*", F.explode(F.array(*[F.lit(x) for x in depths])).alias("depth")).where(F.col(within) < F.col("depth"))


def allocate_blocks(cells: DataFrame, k: int, depths: tuple[int, ...], allocations: int, seed: str) -> DataFrame:
    """allocation, depth, cell_id, stratum, block, within_block_index: rank r goes to block r mod k.

    A stratum with too few cells for k blocks of the largest depth is an error (``short_strata`` lists them).
    """
    refuse_short(cells, k, max(depths))
    df = ranked(cells, allocations, seed, k * max(depths)).withColumn("within_block_index", F.floor(F.col("r") / k).cast("int"))
    return _at_depths(df, depths, "within_block_index").select("allocation", "depth", "cell_id", "stratum", F.concat(F.lit("B"), F.col("r") % k + 1).alias("block"), "within_block_index")


def allocate_contiguous(cells: DataFrame, k: int, depths: tuple[int, ...], allocations: int, seed: str) -> DataFrame:
    """Blocks of max(depths) consecutive ranks; smaller depths are prefixes."""
    most = max(depths)
    refuse_short(cells, k, most)
    df = ranked(cells, allocations, seed, k * most).withColumn("within_block_index", F.col("r") % most)
    return _at_depths(df, depths, "within_block_index").select("allocation", "depth", "cell_id", "stratum", F.concat(F.lit("B"), F.floor(F.col("r") / most) + 1).alias("block"), "within_block_index")


def short_strata(cells: DataFrame, k: int, depth: int) -> DataFrame:
    """Strata with too few cells for k blocks of that depth."""
    return cells.groupBy("stratum").agg(F.count("*").alias("cells")).where(F.col("cells") < k * depth)


def refuse_short(cells: DataFrame, k: int, depth: int) -> None:
    short = short_strata(cells, k, depth).orderBy("stratum").limit(5).collect()
    if short:
        raise ValueError(f"too few cells for {k} blocks of depth {depth}: {[(r['stratum'], r['cells']) for r in short]}")


def scheme_membership(members: DataFrame) -> DataFrame:
    """scheme, rotation, allocation, depth, role, cell_id for shared (all blocks), split and three cross-fit rotations."""
    role = ["observation", "prediction", "input"]
    rows = [(s, rot, r, f"B{b + 1}") for s, rot, shift in SCHEMES for i, r in enumerate(role) for b in (range(3) if shift is None else [(i + shift) % 3])]
    schemes = members.sparkSession.createDataFrame(rows, "scheme string, rotation string, role string, block string")
    return members.join(F.broadcast(schemes), "block").select("scheme", "rotation", "allocation", "depth", "role", "cell_id")


def rule_partitions(spark, budget: int) -> DataFrame:
    """rule, direction, role, row: a plan of the rows 0..budget-1.

    O_x gives the fraction x to the input and the rest to the observed reference; cross-fitting observes
    one fold at a time and gives the others to the input. The two overlap rules observe all rows while
    the input is that of O_half or one half at a time.
    """
    if budget < 4 or budget % 4:
        raise ValueError("the budget must be a positive multiple of four")
    b, q = budget, budget // 4
    plan = [("shared_all_B", 0, "input", 0, b), ("shared_all_B", 0, "observation", 0, b)]
    for name, parts in (("O_quarter", 1), ("O_half", 2), ("O_three_quarters", 3)):
        plan += [(name, 0, "input", 0, parts * q), (name, 0, "observation", parts * q, b)]
    for name, folds in (("crossfit_2", 2), ("crossfit_4", 4)):
        for f in range(folds):
            lo, hi = f * b // folds, (f + 1) * b // folds
            plan += [(name, f, "observation", lo, hi), (name, f, "input", 0, lo), (name, f, "input", hi, b)]
    plan += [("overlap_half", 0, "input", 0, 2 * q), ("overlap_half", 0, "observation", 0, b)]
    for f in range(2):
        plan += [("crossfit2_overlap_all", f, "input", f * b // 2, (f + 1) * b // 2), ("crossfit2_overlap_all", f, "observation", 0, b)]
    df = spark.createDataFrame(plan, "rule string, direction int, role string, lo int, hi int").where("hi > lo")
    return df.select("rule", "direction", "role", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("row"))


def partition_cells(cells: DataFrame, seed: str, share: float = 1.0) -> DataFrame:
    """rule, direction, role, stratum, cell_id: the rules' plan over the cells of each stratum in hash order.

    A stratum's budget is the largest multiple of four within ``share`` of its cells; the plan of four rows
    stands for the budget's quarters, so it is the same at any budget.
    """
    placed = running(cells.select("cell_id", "stratum"), ["stratum"], [hash_rank(seed, F.lit("0"), "cell_id"), "cell_id"], rank="_r", total="_n")
    quarter = F.floor(F.col("_n") * F.lit(share) / 4)
    placed = placed.where(quarter > 0).withColumn("_q", F.floor((F.col("_r") - 1) / quarter)).where("_q < 4")
    plan = F.broadcast(rule_partitions(cells.sparkSession, 4))  # some forty rows
    return placed.join(plan, F.col("_q") == F.col("row")).select("rule", "direction", "role", "stratum", "cell_id")


def rule_cost(partitions: DataFrame) -> DataFrame:
    """Input rows passed forward in all directions, unique ones (what a cache needs), all rows of the rule, and both ratios to these."""
    row = F.when(F.col("role") == "input", F.col("row"))
    cost = partitions.groupBy("rule").agg(F.count(row).alias("forwards"), F.count_distinct(row).alias("unique_rows"), F.count_distinct("row").alias("physical_rows"))
    ratio = lambda c: F.col(c) / F.col("physical_rows")
    return cost.withColumn("uncached_ratio", ratio("forwards")).withColumn("cached_ratio", ratio("unique_rows"))


def role_overlap(pools: DataFrame) -> DataFrame:
    """Per scheme and rotation, whether two roles use the same blocks: 3 x 3, with the pattern of sharing.

    Patterns: S all three roles share, M observation and prediction, P observation and input, O prediction
    and input, D none.
    """
    own = pools.groupBy("scheme", "rotation", "role").agg(F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"))
    a, b = own.alias("a"), own.alias("b")
    same = (F.col("a.blocks") == F.col("b.blocks")).alias("same")
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("blocks")))
    roles = own.groupBy("scheme", "rotation").agg(of("observation").alias("o"), of("prediction").alias("p"), of("input").alias("i"))
    pattern = F.expr("CASE WHEN o = p AND p = i THEN 'S' WHEN o = p THEN 'M' WHEN o = i THEN 'P' WHEN p = i THEN 'O' ELSE 'D' END")
    matrix = a.join(b, (F.col("a.scheme") == F.col("b.scheme")) & (F.col("a.rotation") == F.col("b.rotation"))).select("a.scheme", "a.rotation", F.col("a.role").alias("role_a"), F.col("b.role").alias("role_b"), same)
    return matrix.join(roles.select("scheme", "rotation", pattern.alias("pattern")), ["scheme", "rotation"])
