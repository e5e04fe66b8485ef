"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of ``block_bytes`` bytes. The distinct blocks are sorted and numbered; then
adjacent pairs of numbers are sorted and numbered again, level by level, until every text is one
number. Two texts are equal exactly when they end on the same level with the same number: nothing
rests on a hash being free of collisions. Hashes only say where a block is sorted and looked up, and
blocks that share a hash are told apart by their bytes.

Numbers come from sorting within hash buckets (rank * buckets + bucket). There is one bucket for every
``NAMES_PER_BUCKET`` blocks of the table, so no task sorts more than about so many names, and numbers
depend on the blocks alone, not on partitions or on the order of rows. Numbers are joined back to the
places of the texts by ``attach``, which spreads a block or pair that a third of all places hold.

Defined cases: a null text counts as empty; all empty texts are equal. Null ids are smaller than any
id. Texts of any length are named as a whole (one more level for each doubling). Rows with the same id
and text are equal like any others, one of them stays. An empty table gives an empty result. Other
columns, whatever their names, are not read; ``drop_exact_duplicates`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraspark.llm.common import attach, attach_stats, discard, free_name, materialise

BLOCK_BYTES = 4096
NAMES_PER_BUCKET = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case A-Z alone; pure ASCII texts take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _blocks(data: Column, size: int) -> Column:
    last = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(size))).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _numbered(keys: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """``keys``, whose ``columns`` are distinct, with a positive integer each: the rank among the sorted rows of its bucket."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(buckets))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*columns))
    return keys.withColumn("_bucket", bucket).withColumn("name", rank * F.lit(buckets).cast("long") + F.col("_bucket")).drop("_bucket")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: row, id, text_sha256 (binary), level, name.

    ``hash_bits`` under 64 makes blocks share hashes, for tests of that case.
    """
    docs = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    data = docs.select("id", F.encode("text", "UTF-8").alias("data"))
    hashed = lambda block: F.shiftrightunsigned(F.xxhash64(block), 64 - hash_bits)
    blocks = data.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("block")).select(hashed(F.col("block")).alias("h"), "block")
    distinct = blocks.groupBy("h", "block").agg(F.count("*").alias("places"))
    per_hash = materialise(distinct.groupBy("h").agg(F.count("*").alias("n"), F.sum("places").alias("places")), "block-hashes")
    buckets = max(64, math.ceil((per_hash.agg(F.sum("places")).first()[0] or 0) / NAMES_PER_BUCKET))

    rows = materialise(
        data.select(
            F.monotonically_increasing_id().alias("row"), "id", F.unhex(F.sha2("data", 256)).alias("text_sha256"),
            F.transform(_blocks(F.col("data"), block_bytes), hashed).alias("hashes"),
        ),
        "block-rows",
    )
    placed = rows.select("row", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))

    shared = per_hash.where("n > 1").select("h")
    if shared.isEmpty():
        names = materialise(_numbered(per_hash.select("h", "places"), ["h"], buckets), "block-names")
        current = attach(placed, names, ["h"], F.struct("row", "pos"), rows="places").select("row", "n", "pos", "name")
    else:
        # Blocks that share a hash: number them by content, then find each place's block by content again.
        order = F.row_number().over(Window.partitionBy("h").orderBy("block"))
        apart = distinct.join(shared, "h", "left_semi").select("h", "block", order.alias("k"), "places")
        keys = per_hash.where("n = 1").select("h", F.lit(0).alias("k"), "places").union(apart.select("h", "k", "places"))
        names = materialise(_numbered(keys, ["h", "k"], buckets), "block-names")
        again = docs.select("id", F.encode("text", "UTF-8").alias("data"), F.unhex(F.sha2("text", 256)).alias("sha"))
        found = (
            again.select("id", "sha", F.posexplode(_blocks(F.col("data"), block_bytes)).alias("pos", "block"))
            .withColumn("h", hashed(F.col("block"))).join(shared, "h", "left_semi")
            .join(apart, ["h", "block"]).select(F.col("id").alias("_id"), "sha", F.col("pos").alias("_pos"), "k").distinct()
        )
        withid = placed.join(rows.select("row", "id", "text_sha256"), "row")
        k = withid.join(found, withid["id"].eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("sha")) & (F.col("pos") == F.col("_pos")), "left")
        k = k.select("row", "n", "pos", "h", F.coalesce("k", F.lit(0)).alias("k"))
        current = attach(k, names, ["h", "k"], F.struct("row", "pos"), rows="places").select("row", "n", "pos", "name")

    current = materialise(current, "names")
    done = [current.where("n = 1").select("row", F.lit(0).alias("level"), "name")]
    most, level = rows.agg(F.max(F.size("hashes"))).first()[0] or 1, 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        at = lambda odd: F.coalesce(F.max(F.when(F.col("pos") % 2 == odd, F.col("name"))), F.lit(0))
        pairs = (
            current.where("n > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.floor((F.first("n") + 1) / 2).cast("int").alias("n"), at(0).alias("a"), at(1).alias("b"))
        )
        counted = pairs.groupBy("a", "b").agg(F.count("*").alias("places"))
        names = materialise(_numbered(counted, ["a", "b"], buckets), "pair-names")
        current = materialise(attach(pairs, names, ["a", "b"], F.struct("row", "pos"), rows="places").select("row", "n", "pos", "name"), "names")
        discard(names)
        done.append(current.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    return rows.select("row", "id", "text_sha256").join(named, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Of equal texts the row with the largest id stays (one row, if several have it). (level, name) is
    the identity of the text.
    """
    named = identities(docs, id_col, text_col, block_bytes, hash_bits)
    top = F.max(F.struct(F.col("id"), (-F.col("row")).alias("row"))).alias("top")
    out = attach_stats(named, ["level", "name"], [top, F.count("*").alias("group_size")], F.col("row"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == -F.col("top.row")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"), "level", "name",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Rows that share id and text differ in other columns at most; of those, the first by these columns
    (as JSON text) stays.
    """
    decided = materialise(exact_dedup(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"), "exact-dedup")
    sha = F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)
    keys = decided.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    match = lambda df, other: df[id_col].eqNullSafe(other["_id"]) & (sha == other["_sha"])
    kept = docs.join(keys, match(docs, keys), "left_semi")
    repeated = (
        decided.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("c"), F.max("kept").alias("kept"))
        .where("c > 1 and kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    )
    if repeated.isEmpty():
        return kept
    several = kept.join(repeated, match(kept, repeated), "left_semi")
    first = F.row_number().over(Window.partitionBy(F.col(id_col), sha).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    rank = free_name(docs, "_first")
    return kept.join(repeated, match(kept, repeated), "left_anti").unionByName(several.withColumn(rank, first).where(F.col(rank) == 1).drop(rank))
