"""Merkle manifest of a table: leaves placed by ranks in compressed bitmaps, levels reduced in slot arrays.

Each row is a leaf. Leaves of one group (a column's value) ascend by id; every ``FANOUT`` consecutive
nodes make one of the level above, until one is left, the group's subroot. The subroots, ordered by
group, make the root in the same way.

Where a leaf stands is not found by sorting. The ids of a group make a bitmap of 64-bit words; words
without ids are not stored, and the words that tasks have built are merged by OR. A popcount directory
counts the rows before each container of 16 words (its counts are summed by two further prefixes of the
id, so no running sum goes over more than 2**19 entries), and a row's place is its container's count plus
the bits below its own. A place divided by ``BLOCK`` is the key of a slot array, the remainder the slot.
A task fills such an array and reduces it by up to four levels; its top nodes are the leaves of the next
pass, 4096 times fewer. The way back joins each array with the path of its top node.

Defined cases: a null group is a group of its own before all others; null ids stand before all ids.
Rows that share group and id are ordered by their digests (then by the other columns); they are placed
by counts of equal rows, so no task gathers them, however many they are. Equal rows are leaves of their
own each. Texts of any length are hashed as a whole; null values have a digest of their own. An empty
table gives an empty result. All other columns of the table, whatever their names, are passed on; they
must be comparable (no maps) where rows repeat an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraspark.llm.common import attach, materialise

FANOUT = 8
#: Levels that one pass reduces, and the leaves of a slot array.
LEVELS = 4
BLOCK = FANOUT**LEVELS
#: Ids of one container: 2**CONTAINER words; bits of its number that each level of the directory resolves.
CONTAINER, RADIX = 4, 18
#: Word of null ids, below the word of the least integer.
_NULL_WORD = -(1 << 57) - 1
#: Copies of a repeated row that one task numbers.
_COPIES = 65536
RESULTS = ["path", "subroot", "root"]
PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def field(value: Column) -> Column:
    """A value so written that a row of them can be told apart: its UTF-8 byte count, a colon, its text; null is '-'."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the written values."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(total: int) -> int:
    """Levels that a pass reduces of a tree with so many nodes."""
    n = 0
    while total > 1 and n < LEVELS:
        total, n = -(-total // FANOUT), n + 1
    return n


def _reduce(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up."""
    out = [nodes]
    for _ in range(levels):
        out.append([_hash("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def _paths(levels: list[list[str]]) -> tuple[list[str], list[str]]:
    """Left and right siblings of each node of the lowest level, level by level: entry [node * steps + step]."""
    n, steps = len(levels[0]), len(levels) - 1
    left, right = [""] * (n * steps), [""] * (n * steps)
    for k, nodes in enumerate(levels[:-1]):
        before, after = [], []
        for i in range(len(nodes)):
            run = i - i % FANOUT
            before.append("".join(nodes[run:i]))
            after.append("".join(nodes[i + 1 : run + FANOUT]))
        own = [i // FANOUT**k for i in range(n)]
        left[k::steps], right[k::steps] = [before[i] for i in own], [after[i] for i in own]
    return left, right


def _fill(table: pa.Table) -> pa.Table:
    """Rows of one slot array to one row: the array and its top node."""
    slot = table["place"].to_numpy() % BLOCK
    at = np.empty(len(slot), np.int64)
    at[slot] = np.arange(len(slot))
    leaves, carried = (table[name].take(pa.array(at)).combine_chunks() for name in ("leaf", "c"))
    total = table["total"][0].as_py()
    top = _reduce([x.hex() for x in leaves.to_pylist()], _levels(total))[-1]
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), values)
    first = table.slice(0, 1)
    columns = [first["k"], first["block"], pa.array([total], pa.int64()), pa.array([bytes.fromhex(top[0])], pa.binary()), whole(leaves), whole(carried)]
    return pa.table(columns, ["k", "block", "total", "top", "leaves", "c"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slot arrays, each with the path of its top node, to one row for each node with its own path."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            leaves = row["leaves"].values
            levels = _reduce([x.hex() for x in leaves.to_pylist()], _levels(row["total"].as_py()))
            n, steps, above = len(leaves), len(levels) - 1, row["path"].as_py()
            left, right = _paths(levels)
            l_all, r_all = [], []
            for j in range(n):
                l_all += left[j * steps : (j + 1) * steps] + [s["left"] for s in above]
                r_all += right[j * steps : (j + 1) * steps] + [s["right"] for s in above]
            steps += len(above)
            paths = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * steps, pa.int32()), pa.StructArray.from_arrays([pa.array(l_all, pa.string()), pa.array(r_all, pa.string())], ["left", "right"]))
            same = lambda value, kind: pa.repeat(pa.scalar(value.as_py(), kind), n)  # noqa: E731, B023
            columns = [same(row["k"], pa.string()), pa.array(row["block"].as_py() * BLOCK + np.arange(n)), leaves.cast(pa.binary()), row["c"].values, paths, same(row["subroot"], pa.string()), same(row["root"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "place", "leaf", "c", "path", "subroot", "root"])


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Slot arrays of all passes over nodes (k, place, total, leaf, c), the lowest first; ``most``: nodes of the largest tree."""
    passes = []
    while True:
        keyed = nodes.withColumn("block", F.floor(F.col("place") / F.lit(BLOCK)).cast("long"))
        kind = T.StructType().add("k", "string").add("block", "long").add("total", "long").add("top", "binary").add("leaves", T.ArrayType(T.BinaryType())).add("c", T.ArrayType(nodes.schema["c"].dataType))
        passes.append(materialise(keyed.groupBy("k", "block").applyInArrow(_fill, kind), "slots"))
        if most <= BLOCK:
            return passes
        most = -(-most // BLOCK)
        nodes = passes[-1].select("k", F.col("block").alias("place"), F.ceil(F.col("total") / F.lit(BLOCK)).cast("long").alias("total"), F.col("top").alias("leaf"), F.lit(True).alias("c"))


def _descend(passes: list[DataFrame], paths: DataFrame) -> DataFrame:
    """k, place, leaf, c, path, subroot, root of the nodes of the lowest pass; paths (k, block, path, subroot, root): of the top ones."""
    for slots in reversed(passes):
        c = slots.schema["c"].dataType.elementType
        kind = T.StructType().add("k", "string").add("place", "long").add("leaf", "binary").add("c", c).add("path", PATH).add("subroot", "string").add("root", "string")
        nodes = slots.join(paths, ["k", "block"]).select("k", "block", "total", "leaves", "c", "path", "subroot", "root").mapInArrow(_expand, kind)
        paths = nodes.select("k", F.col("place").alias("block"), "path", "subroot", "root")
    return nodes


def _directory(counts: DataFrame) -> DataFrame:
    """k, p, start (the rows of k before p) and total (those of k) from counts (k, p, n): sums over two prefixes of p, then inside each."""
    levels = [counts.select("k", "p", "n")]
    for _ in range(2):
        levels.append(levels[-1].groupBy("k", F.shiftright("p", RADIX).alias("p")).agg(F.sum("n").alias("n")))
    before = lambda *part: F.sum("n").over(Window.partitionBy(*part).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    found = levels[2].withColumn("start", before("k")).withColumn("total", F.sum("n").over(Window.partitionBy("k"))).select("k", F.col("p").alias("_p"), "start", "total")
    for level in (levels[1], levels[0]):
        inner = level.withColumn("_p", F.shiftright("p", RADIX)).withColumn("_in", before("k", "_p"))
        found = inner.join(found, ["k", "_p"]).select("k", F.col("p").alias("_p"), (F.col("start") + F.col("_in")).alias("start"), "total")
    return found.withColumnRenamed("_p", "p")


def _repeats(rows: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Rows whose id their group has more than once: (copies of each different row, and how many rows stand before it
    among those of its id), (k, w, extras: bit and number of rows beyond the first). None where no id repeats."""
    several = materialise(words.where(F.col("n") > F.bit_count("bits")).select("k", "w", "n"), "repeats")
    if several.isEmpty():
        return None
    found = attach(rows, several, ["k", "w"], F.col("leaf"), rows="n")
    kinds = materialise(found.groupBy("k", "w", "b", "leaf", "c").agg(F.count("*").alias("copies")), "repeats")
    ids = materialise(kinds.groupBy("k", "w", "b").agg(F.sum("copies").alias("rows"), F.count("*").alias("kinds")).where("rows > 1"), "repeats")
    kinds = attach(kinds, ids.select("k", "w", "b", "kinds"), ["k", "w", "b"], F.col("leaf"), rows="kinds")
    # Digests are even: their first two bytes deal the rows of one id out, and a running sum goes over the 65,536 counts.
    kinds = materialise(kinds.withColumn("q", F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int")), "repeats")
    running = lambda value, *part: F.sum(value).over(Window.partitionBy(*part).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    dealt = kinds.groupBy("k", "w", "b", "q").agg(F.sum("copies").alias("rows")).withColumn("start", running("rows", "k", "w", "b"))
    inner = Window.partitionBy("k", "w", "b", "q").orderBy("leaf", "c").rowsBetween(Window.unboundedPreceding, 0)
    placed = kinds.withColumn("_in", F.sum("copies").over(inner) - F.col("copies")).join(dealt.drop("rows"), ["k", "w", "b", "q"])
    placed = placed.select("k", "w", "b", "leaf", "c", "copies", (F.col("start") + F.col("_in")).alias("among"))
    extras = ids.groupBy("k", "w").agg(F.collect_list(F.struct("b", (F.col("rows") - 1).alias("n"))).alias("extras"))  # 64 entries at most
    return placed, extras


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (k, w, b, leaf, c) with place, their rank in k by id, and total, the rows of k; and the largest total.

    w and b are the word and the bit of the id; ``rows`` must be materialised.
    """
    words = materialise(rows.groupBy("k", "w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"), F.count("*").alias("n")), "bitmap-words")
    again = _repeats(rows, words)
    none = F.expr("CAST(array() AS array<struct<b: int, n: bigint>>)")
    held = words.withColumn("extras", none) if again is None else words.join(again[1], ["k", "w"], "left").withColumn("extras", F.coalesce("extras", none))
    held = held.withColumn("p", F.shiftright("w", CONTAINER))
    before = F.sum("n").over(Window.partitionBy("k", "p").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    held = held.withColumn("before", before).groupBy("k", "p").agg(F.collect_list(F.struct("w", "bits", "before", "extras")).alias("words"), F.sum("n").alias("n"))
    containers = materialise(held.join(_directory(held.select("k", "p", "n")), ["k", "p"]), "bitmap-containers")
    most = containers.agg(F.max("total")).first()[0] or 0

    def rank(df: DataFrame) -> DataFrame:
        """df with total, start (the rows of smaller ids) and repeated (whether other rows share the id)."""
        df = attach(df.withColumn("p", F.shiftright("w", CONTAINER)), containers, ["k", "p"], F.col("leaf"), rows="n")
        word = F.filter("words", lambda x: x["w"] == F.col("w"))[0]
        df = df.withColumn("word", word)
        below = F.bit_count(F.col("word.bits").bitwiseAND(F.expr("~shiftleft(-1L, b)")))
        more = F.aggregate(F.filter("word.extras", lambda x: x["b"] < F.col("b")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return df.withColumn("start", F.col("start") + F.col("word.before") + below + more).withColumn("repeated", F.exists("word.extras", lambda x: x["b"] == F.col("b")))

    own = rank(rows)
    out = (own if again is None else own.where(~F.col("repeated"))).select("k", F.col("start").alias("place"), "total", "leaf", "c")
    if again is not None:
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.lit(_COPIES)).cast("long")))
        dealt = rank(again[0]).withColumn("part", parts).repartition("leaf", "part")
        nth = F.explode(F.sequence(F.col("part") * _COPIES, F.least("copies", (F.col("part") + 1) * F.lit(_COPIES)) - 1))
        out = out.union(dealt.withColumn("nth", nth).select("k", (F.col("start") + F.col("among") + F.col("nth")).alias("place"), "total", "leaf", "c"))
    return out, most


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """df with place, its rank by a column of distinct values: places inside sorted ranges plus the rows of the ranges before."""
    row = materialise(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_row", F.monotonically_increasing_id()), "ranges")
    part, inside = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    sums = row.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    sums = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))  # a row for each partition
    return row.withColumn("_part", part).join(F.broadcast(sums), "_part").withColumn("place", F.col("_start") + inside).drop("_row", "_part", "_start")


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf") -> DataFrame:
    """``leaves`` (one row a leaf, its digest as hex text) with path, subroot and root.

    path: for each level from the leaf's up to the root the siblings left and right of its own node, as
    joined hex text, so ``fold`` and ``proof_digest`` need nothing else. Columns with the names of the
    results are replaced.
    """
    spark, leaves = leaves.sparkSession, leaves.drop(*RESULTS)
    plain = leaves.toDF(*[f"c{i}" for i in range(len(leaves.columns))])
    own = {c: f"c{i}" for i, c in enumerate(leaves.columns)}
    number, group = F.col(own[id_col]).cast("long"), F.col(own[group_col]).cast("string")
    # The digest is carried once, as the leaf.
    carried = F.struct(*[F.col(c) for c in plain.columns if c != own[leaf_col]])
    rows = materialise(
        plain.select(
            F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("k"), F.coalesce(F.shiftright(number, 6), F.lit(_NULL_WORD)).alias("w"),
            F.coalesce(number.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("b"), F.unhex(own[leaf_col]).alias("leaf"), carried.alias("c"),
        ),
        "leaves",
    )
    nodes, most = placed(rows)
    if not most:
        return spark.createDataFrame([], T.StructType([*leaves.schema.fields]).add("path", PATH).add("subroot", "string").add("root", "string"))
    passes = _climb(nodes, most)
    subroots = _numbered(passes[-1].select(F.col("k").alias("c"), F.col("top").alias("leaf")), "c")
    groups = subroots.count()
    over = _climb(subroots.select(F.lit("").alias("k"), "place", F.lit(groups).cast("long").alias("total"), "leaf", "c"), groups)
    top, no_path = F.lower(F.hex("top")), F.expr(f"CAST(array() AS {PATH.simpleString()})")
    above = _descend(over, over[-1].select("k", "block", no_path.alias("path"), F.lit(None).cast("string").alias("subroot"), top.alias("root")))
    above = materialise(above.select(F.col("c").alias("k"), F.lit(0).cast("long").alias("block"), "path", F.lower(F.hex("leaf")).alias("subroot"), "root"), "paths")
    out = _descend(passes, above)
    leaf = F.lower(F.hex("leaf"))
    return out.select(*[(leaf if c == own[leaf_col] else F.col(f"c.{c}")).alias(name) for name, c in own.items()], *RESULTS)
