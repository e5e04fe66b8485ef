"""Counts to profiles: normalisation, panels, scales, group means. Zeros are implicit in count triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalize_cp10k(counts: DataFrame) -> DataFrame:
    """ln(1 + 10000 * count / total of the cell), the total over all genes of the cell. A cell whose counts are all zero is an error."""
    total = F.sum("cnt").over(Window.partitionBy("cell_id"))
    empty = F.raise_error(F.concat(F.lit("a cell without counts: "), F.col("cell_id").cast("string"))).cast("double")
    value = F.when(F.col("total") > 0, F.log1p(F.col("cnt") * 10000.0 / F.col("total"))).otherwise(empty)
    return counts.withColumn("total", total).select("cell_id", "gene", value.alias("value"))


def gene_moments(values: DataFrame, n_cells: int) -> DataFrame:
    """Mean and population variance of each gene over n_cells cells, implicit zeros included.

    The variance is put together from that of the values, and from the distances of their mean and of the zeros to the mean of all.
    """
    m = values.groupBy("gene").agg((F.sum("value") / n_cells).alias("mean"), F.avg("value").alias("own"), F.var_pop("value").alias("v"), F.count("value").alias("n"))
    off, mean = F.col("own") - F.col("mean"), F.col("mean")
    return m.select("gene", "mean", ((F.col("n") * (F.col("v") + off * off) + (n_cells - F.col("n")) * mean * mean) / n_cells).alias("variance"))


def topk_variance(moments: DataFrame, k: int) -> DataFrame:
    """The k genes of largest variance, the smaller gene id of equals."""
    return moments.orderBy(F.desc("variance"), "gene").limit(k).select("gene", "variance")


def gene_scales(moments: DataFrame, n_cells: int, ddof: int = 1, floor: float = 0.1) -> DataFrame:
    return moments.select("gene", F.greatest(F.sqrt(F.col("variance") * n_cells / (n_cells - ddof)), F.lit(floor)).alias("scale"))


def pseudobulk_mean(values: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """Mean profile of each group of cells; cells (cell_id, key...) without a value count as zero."""
    n = cells.groupBy(*key).agg(F.count("*").alias("n"))
    s = values.join(cells, "cell_id").groupBy(*key, "gene").agg(F.sum("value").alias("s"))
    return s.join(n, key).select(*key, "gene", (F.col("s") / F.col("n")).alias("value"))


def equal_stratum_mean(long: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Mean over strata of the strata's means."""
    return long.groupBy(stratum, "gene").agg(F.avg("value").alias("m")).groupBy("gene").agg(F.avg("m").alias("value"))


def matched_effect(long: DataFrame, library: str, treated: str, task: str) -> DataFrame:
    """Treated minus control mean within a library, then the mean over the libraries of a task."""
    m = long.groupBy(library, task, "gene").agg(F.avg(F.when(F.col(treated), F.col("value"))).alias("t"))
    c = long.where(~F.col(treated)).groupBy(library, "gene").agg(F.avg("value").alias("c"))
    return m.where("t is not null").join(c, [library, "gene"]).groupBy(task, "gene").agg(F.avg(F.col("t") - F.col("c")).alias("value"))


def canonical_condition(column: str, alias: dict[str, str]):
    """Parts between "+" with aliases resolved, sorted, joined again."""
    part = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in alias.items() for v in kv]), x), x) if alias else x
    return F.array_join(F.array_sort(F.transform(F.split(column, r"\+"), part)), "+")


def task_pools(cells: DataFrame, tasks: DataFrame, control: str) -> DataFrame:
    """task, pool, cell_id: cells of the task's unit that have its condition, or the control's."""
    j = cells.join(F.broadcast(tasks.select("task", F.col("unit").alias("u"), F.col("condition").alias("wanted"))), F.col("unit") == F.col("u"))
    pool = F.when(F.col("condition") == F.col("wanted"), "treated").when(F.col("condition") == control, "control")
    return j.withColumn("pool", pool).where("pool is not null").select("task", "pool", "cell_id")


def eligible_tasks(pools: DataFrame, least: int) -> DataFrame:
    n = pools.groupBy("task").agg(*[F.count_if(F.col("pool") == p).alias(p) for p in ("treated", "control")])
    return n.where(F.least("treated", "control") >= least)
