"""Removal of lines that several documents share, by sorted ranges of line hashes.

Each line of at least ``least_chars`` code points gives a row (hash, id, position). The rows are
partitioned by range of hash, id and position, and sorted inside each partition by hash, then larger ids
first, then position. One pass over a partition streams the runs of equal hashes: the first document of a
run is the one that keeps the line, and from the third different document on every further one loses it.
The pass holds one document's rows at most. A line that very many documents share spans several ranges.
Runs that touch a partition's border are settled afterwards: a partition reports its first and its last
run as counts (two rows each, the only thing broadcast), and their rows are decided by the sums.

The result is no text but, for each document that loses lines, a compressed bitmap of the lines that
stay; ``apply`` joins it to the texts.

Lines are cut at \\n alone. A line's key is the line without ASCII space and \\t \\n \\v \\f \\r at both ends, A-Z
lower-cased; keys are compared by 96 bits of two independent hashes.

Defined cases: a null text and an empty one are one empty line. Rows that share an id are one document:
they count once, and all of them keep the lines that their id keeps. Null ids together are one document,
with the least 64-bit integer as its id. A line that a document repeats is one occurrence of its key; all
its places share the decision. Repeated rows get the same result each. Texts of any length are read as a
whole. Columns named like the results are replaced, all others kept. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraspark.llm.common import attach, discard, materialise, slices, text_bytes
from contraspark.llm.words import LOWER, SPACE
from contraspark.llm.words import _hashes as span_hashes

LEAST_CHARS, LEAST_DOCS = 20, 3
RESULTS = ["n_lines", "n_dropped", "keep"]
_LEAST_ID = -(1 << 63)
_DROP, _EDGE, _RUN = 0, 1, 2


def encode_bitmap(n: int, dropped: np.ndarray) -> bytes:
    """A bit for each of n lines, set where the line stays, deflated."""
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def decode_bitmap(data: bytes, n: int) -> np.ndarray:
    """Whether each of n lines stays."""
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n, bitorder="little").astype(bool)


def split_lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all texts, and the first line of each text."""
    cut = np.flatnonzero(raw == 10)
    first = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(cut, offsets)) + 1)])
    start, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    head, tail = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    start[head], start[~head] = offsets[:-1], cut + 1
    end[tail], end[~tail] = offsets[1:], cut
    return start, end, first


def _strip(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at both ends (empty ones stand at their start)."""
    solid = np.flatnonzero(~SPACE[raw])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = a < b
    solid = np.append(solid, 0)
    return np.where(some, solid[np.minimum(a, len(solid) - 1)], start), np.where(some, solid[b - 1] + 1, start)


def _emit_lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column(2))
            start, end, first = split_lines(raw, offsets)
            count = np.diff(first)
            doc = np.repeat(np.arange(batch.num_rows), count)
            at = np.arange(len(start)) - first[:-1][doc]
            a, b = _strip(raw, start, end)
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            long = points[b] - points[a] >= least_chars
            a, b, doc, at = a[long], b[long], doc[long], at[long]
            body = LOWER[raw]
            one, two = (span_hashes(body, a, b, which) for which in (0, 1))
            where = pa.array(doc)
            columns = [pa.array(one.astype(np.int64)), pa.array((two >> np.uint64(32)).astype(np.int32)), batch.column(0).take(where), batch.column(1).take(where), pa.array(at.astype(np.int32)), pa.array(count[doc].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "id", "t", "at", "n"])

    return run


_FOUND = "kind int, part int, h1 long, h2 int, id long, t long, at int, n int, docs long, low long"


class _Stream:
    """The state of one partition's pass: the run it stands in and the rows of that run's second document."""

    def __init__(self, part: int, least_docs: int):
        self.part, self.least, self.out = part, least_docs, []
        self.key, self.is_first, self.top, self.last, self.docs, self.wait = None, True, None, None, 0, []

    def close(self, border: bool) -> None:
        """End of the run. At a border its count is reported and the rows that wait are left open."""
        if self.key is not None and (border or self.is_first):
            self.out.append((_RUN, self.part, *self.key, self.top, None, None, None, self.docs, self.last))
            self.out += [(_EDGE, self.part, *self.key, *row, None, None) for row in self.wait]
        self.wait = []

    def take(self, keys: np.ndarray, ids: np.ndarray, t: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """A sorted batch, one step for each document of a run: its rows stay, wait, or go."""
        new = np.ones(len(ids), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        cut = np.flatnonzero(new)
        # Keys of one row, which most are, change nothing unless they stand at a border.
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
            key, doc = (int(keys[lo]["h1"]), int(keys[lo]["h2"])), int(ids[lo])
            if key != self.key:
                if self.key is not None:
                    self.close(False)
                    self.is_first = False
                self.key, self.top, self.docs, self.last = key, doc, 1, doc
            elif doc != self.last:
                self.docs, self.last = self.docs + 1, doc
            rows = zip(ids[lo:hi].tolist(), t[lo:hi].tolist(), at[lo:hi].tolist(), n[lo:hi].tolist(), strict=True)
            if self.is_first:  # a partition before may hold the same key with larger ids
                self.out += [(_EDGE, self.part, *key, *row, None, None) for row in rows]
            elif doc != self.top:
                if self.docs < self.least:
                    self.wait += list(rows)
                else:
                    self.out += [(_DROP, self.part, *key, *row, None, None) for row in [*self.wait, *rows]]
                    self.wait = []


def _decide(least_docs: int):
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("docs", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(TaskContext.get().partitionId(), least_docs)
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stream.out, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            h1, h2, ids, t, at, n = (batch.column(c).to_numpy() for c in ("h1", "h2", "id", "t", "at", "n"))
            keys = np.empty(len(h1), [("h1", np.int64), ("h2", np.int32)])
            keys["h1"], keys["h2"] = h1, h2
            # A row whose key both neighbours in the batch lack is a run of its own: of one document, it stays.
            alone = np.ones(len(h1), bool)
            same = keys[1:] == keys[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            alone[:1] = alone[-1:] = False
            keep = ~alone
            stream.take(keys[keep], ids[keep], t[keep], at[keep], n[keep])
            if stream.out:
                yield flush()
                stream.out = []
        stream.close(True)
        if stream.out:
            yield flush()

    return run


@F.arrow_udf(T.BinaryType())
def _bitmaps(n: pa.Array, dropped: pa.Array) -> pa.Array:
    return pa.array([encode_bitmap(k, np.array(d)) for k, d in zip(n.to_pylist(), dropped.to_pylist(), strict=True)], pa.binary())


@F.arrow_udf(T.StringType())
def _kept(text: pa.Array, keep: pa.Array) -> pa.Array:
    """The lines that stay, joined by \\n; null where there is no bitmap."""
    out = []
    for value, bits in zip(text, keep, strict=True):
        if not bits.is_valid:
            out.append(None)
            continue
        lines = (value.as_py() or "").split("\n")
        out.append("\n".join(x for x, stays in zip(lines, decode_bitmap(bits.as_py(), len(lines)).tolist(), strict=True) if stays))
    return pa.array(out, pa.string())


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, t (hash of the text), n_lines, n_dropped and keep (see ``encode_bitmap``) of each document that loses lines; null ids are the least integer."""
    own, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)), F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(own.alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(_emit_lines(least_chars), "h1 long, h2 int, id long, t long, at int, n int")
    lines = materialise(lines.withColumn("part", F.spark_partition_id()), "lines")
    order = ["h1", "h2", F.desc("id"), "at", "t", "part"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order).drop("part")
    found = materialise(dealt.mapInArrow(_decide(least_docs), _FOUND), "found-lines")
    discard(lines)

    # Runs at borders: at most two rows for each partition.
    key = Window.partitionBy("h1", "h2").orderBy("part")
    runs = found.where(F.col("kind") == _RUN).withColumn("again", (F.lag("low").over(key) == F.col("id")).cast("long"))
    runs = runs.groupBy("h1", "h2").agg(F.sum(F.col("docs") - F.coalesce("again", F.lit(0))).alias("docs"), F.max("id").alias("top")).where(F.col("docs") >= least_docs)
    edges = found.where(F.col("kind") == _EDGE).drop("docs").join(F.broadcast(runs), ["h1", "h2"]).where(F.col("id") != F.col("top"))
    drops = found.where(F.col("kind") == _DROP).select("id", "t", "at", "n").union(edges.select("id", "t", "at", "n"))
    per_doc = drops.groupBy("id", "t").agg(F.max("n").alias("n_lines"), F.collect_set("at").alias("dropped"))  # a document's lines
    return materialise(per_doc.select("id", "t", "n_lines", F.size("dropped").alias("n_dropped"), _bitmaps("n_lines", "dropped").alias("keep")), "line-bitmaps")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and keep, the bitmap of the lines that stay (null where all stay). See ``apply`` for the texts."""
    docs = docs.drop(*RESULTS)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    found = keep_bitmaps(plain, own, text, least_chars, least_docs)
    keyed = plain.withColumn("id", F.coalesce(F.col(own).cast("long"), F.lit(_LEAST_ID))).withColumn("t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = attach(keyed, found.select("id", "t", F.col("n_dropped").alias("d"), "keep"), ["id", "t"], F.col("t"), how="left")
    lines = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    return joined.select(*plain.columns, lines.cast("long").alias("n_lines"), F.coalesce("d", F.lit(0)).cast("long").alias("n_dropped"), "keep").toDF(*docs.columns, *RESULTS)


def apply(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The result of ``line_dedup`` with each text cut to the lines that stay. Texts that keep all lines do not leave the JVM."""
    text = F.coalesce(text_col, F.lit(""))
    kept = F.coalesce(_kept(F.when(F.col("keep").isNotNull(), text), F.col("keep")), text)
    return docs.withColumn(text_col, kept)
