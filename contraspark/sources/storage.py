"""Tables on shared storage: tab-separated files with a declared schema, Parquet, publishing once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = T.StructType([*[T.StructField(c, T.StringType()) for c in ("case_id", "unit", "budget", "realization", "model")], T.StructField("score", T.DoubleType())])


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors and driver share (spark.checkpoint.dir); only a local master may lack it and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that ``keep`` wrote in this process.
_kept: dict[str, SparkSession] = {}


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read back: what follows has no lineage to lose."""
    path = work_path(df.sparkSession, name)
    _kept[path] = df.sparkSession
    return publish_once(df, path)


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that ``keep`` wrote, after the results that rest on them have been read. Returns their number."""
    mine = [p for p, s in _kept.items() if s is spark]
    for path in mine:
        del _kept[path]
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(mine)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of tab-separated files; a header or value that does not fit the schema fails."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, sep="\t", header=True)


def publish_once(df: DataFrame, path: str) -> DataFrame:
    """Write a result that must not exist yet, and return it as published."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide_to_long(df: DataFrame, reserved: list[str], name: str = "gene", value: str = "value") -> DataFrame:
    """Every column that is not reserved is a gene."""
    return df.unpivot(reserved, [c for c in df.columns if c not in reserved], name, value)


def align_genes(profile: DataFrame, genes: DataFrame) -> DataFrame:
    """Values on the expected axis genes (gene, idx); genes of one side alone are returned with a reason."""
    p, g = profile.alias("p"), genes.alias("g")
    reason = F.when(F.col("p.gene").isNull(), "missing").when(F.col("g.gene").isNull(), "unexpected").otherwise("ok")
    return p.join(g, F.col("p.gene") == F.col("g.gene"), "full").select(F.coalesce("p.gene", "g.gene").alias("gene"), "g.idx", "p.value", reason.alias("reason"))


def count_triples(df: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows that are no valid count: negative, fractional, null, or with a repeated key."""
    bad = df.where(F.col(count).isNull() | (F.col(count) < 0) | (F.col(count) != F.floor(count))).select(*keys, F.lit("value").alias("reason"))
    return bad.union(df.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate").alias("reason")))


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Digest of the rows that does not depend on their order: all 256 bits of each row's hash are summed, in eight parts.

    A value is written as its length, a colon and its text, null as "-", so no two rows share a text.
    """
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    row = F.sha2(F.concat(*[text(c) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).cast("string")
    sums = F.concat_ws(",", *[part(i) for i in range(8)])
    return df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), sums.alias("digest_sums"), F.min("h").alias("digest_min"), F.max("h").alias("digest_max"))


def membership_digest(df: DataFrame, group: list[str], member: str) -> DataFrame:
    """SHA-256 of the sorted members of each group."""
    return df.groupBy(*group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), "\n"), 256).alias("digest"))


def frozen_check(now: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows that a recomputed and a saved table do not share, with the side that has them."""
    return now.exceptAll(saved).withColumn("side", F.lit("now")).union(saved.exceptAll(now).withColumn("side", F.lit("saved")))
