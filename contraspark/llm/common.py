"""Shared storage, salted joins and batch slicing used by the operators of this folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; bounds a task's memory whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20
#: Keys of more rows than this, if also of more than one in HOT_KEYS of all rows, are spread when a table is joined to them.
HOT_ROWS, HOT_KEYS = 200_000, 4096


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Only a local master may lack that setting; it then gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that ``materialise`` wrote in this process, by the frame that reads them.
_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: what follows has no lineage to lose."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more (all that was made of them has been written itself)."""
    for table in tables:
        for path in {re.sub(r"/part-[^/]*$", "", f) for f in table.inputFiles()}:
            for known in [w for w in _written if w.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]]:
                _delete(known)


def written() -> set[str]:
    """The tables on shared storage so far (see ``clean_up``)."""
    return set(_written)


def clean_up(spark: SparkSession, besides: set[str] = frozenset()) -> int:
    """Delete the tables still kept on shared storage, but for ``besides``, after the results that rest on them have been read. Returns their number."""
    mine = [p for p, s in _written.items() if s is spark and p not in besides]
    for path in mine:
        _delete(path)
    return len(mine)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def attach(df: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "inner", rows: str | None = None) -> DataFrame:
    """Join ``table``, which has one row for each key, to the rows of ``df`` by null-safe equality of ``keys``.

    ``rows`` names a column of the table with the number of rows of ``df`` that have the key (it is not
    joined). Keys of more than ``HOT_ROWS`` rows and of more than one in ``HOT_KEYS`` of all, so fewer
    than ``HOT_KEYS`` ones, are hot: their rows are dealt over one place for each such number of rows
    by ``spread``, and their row of the table is repeated as often, so that a key that holds a third of
    all rows is not gathered in one task. The table should be materialised, as it is read twice.
    """
    names = [c for c in table.columns if c not in keys and c != rows]
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = lambda left, first="_k": [left[k].eqNullSafe(F.col(f"{first}{i}")) for i, k in enumerate(keys)]
    total = table.agg(F.sum(rows)).first()[0] or 0 if rows else 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    if total <= most or table.where(F.col(rows) > most).isEmpty():
        joined = df.join(table.select(*key, *names), reduce(lambda a, b: a & b, same(df)), how)
        return joined.select(*df.columns, *names)
    places = F.ceil(F.col(rows) / F.lit(most)).cast("int")
    # Fewer than HOT_KEYS rows, whatever the table's size.
    hot = F.broadcast(table.where(F.col(rows) > most).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], places.alias("_places")))
    left = df.join(hot, reduce(lambda a, b: a & b, same(df, "_h")), "left")
    left = left.select(*df.columns, F.pmod(F.xxhash64(spread), F.coalesce("_places", F.lit(1))).cast("int").alias("_s1"))
    right = table.select(*key, *names, F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > most, places).otherwise(1) - 1)).alias("_s2"))
    on = reduce(lambda a, b: a & b, same(left)) & (F.col("_s1") == F.col("_s2"))
    return left.join(right, on, how).select(*df.columns, *names)


def attach_stats(df: DataFrame, keys: list[str], aggs: list[Column], spread: Column, having: Column | None = None, most: int | None = None) -> DataFrame:
    """Join statistics of each key's rows, aggregated before their shuffle, back to the rows (see ``attach``).

    ``most`` is a known bound of the rows of ``df``: below HOT_ROWS no key is hot, and nothing needs to be counted.
    """
    stats = df.groupBy(*keys).agg(*aggs, F.count("*").alias("_rows"))
    if most is not None and most <= HOT_ROWS:
        return attach(df, (stats if having is None else stats.where(having)).drop("_rows"), keys, spread)
    return attach(df, materialise(stats if having is None else stats.where(having), "statistics"), keys, spread, rows="_rows")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Return freed memory, which Arrow and the C library would keep, to the system: a worker stays for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a piece hold ``limit`` bytes at most (one longer text stands alone)."""
    for batch in batches:
        yield from _pieces(batch, text, limit)
        del batch
        give_back()


def _pieces(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    column = batch.column(batch.schema.get_field_index(text))
    size = np.zeros(len(column) + 1, np.int64)
    np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), out=size[1:])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and their offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def list_array(values: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
