"""N-gram Jaccard self-join by MinHash banding, verified on the full n-gram sets.

1. Each text becomes its set of five-word shingles (64-bit hashes; ASCII-lower-cased words between
   ASCII blanks; a text of one to four words is one shingle). Texts with equal sets (128-bit digest and
   size) are one class with a number of its own.
2. ``bands`` x ``rows`` MinHash values per class. ``choose_bands`` takes the fewest bands that reach
   the target recall for a pair at exactly the threshold. Classes are shuffled on their band hashes;
   a bucket links its members to its first one, never all pairs.
3. Connected candidates form groups. Large groups are dealt into blocks by hash, and the tasks get
   pairs of blocks, so that no task holds more than two blocks of sets. In there all pairs are verified
   on the full sets, by counting common shingles; links are counted, not returned one by one.

The result has one row per document: its class (the smallest id of the documents connected by links)
and its number of links, that is of other documents of its group of candidates with similarity >=
threshold, copies counted one by one. Since groups are verified completely, links beyond those that
share a band are found too.

Defined cases: rows without words, and rows with a null id, have no links (class: their own id).
Repeated rows are documents of their own and link to each other; so do rows of one id with other texts,
whose classes are kept apart. Whole texts count, whatever their length; a similarity of exactly the
threshold is a link (integers are compared, so nothing is rounded). An empty table gives an empty one.
Columns other than id and text are not read; ``drop_near_duplicates`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contraspark.llm.common import attach, attach_stats, list_array, materialise, slices
from contraspark.llm.graph import connected_components
from contraspark.llm.words import mix, run_starts, runs, split_words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
BAND_ROWS = 5
#: A block of a group holds about so many classes and so many shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles held by more classes of a block pair than this are counted by matrix products.
DENSE_FROM = 24
#: Pairs of sets listed at once while common shingles are counted.
PAIRS_AT_ONCE = 1 << 21
_KEY = ["s1", "s2", "n"]


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Fewest bands with 1 - (1 - threshold**rows)**bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their offsets."""
    words = split_words(column, lower=True)
    n, counts = len(column), np.diff(words.first)
    starts, offsets = run_starts(words.first, size)
    doc, value = np.repeat(np.arange(n), np.diff(offsets)), runs(words.hash, size)[starts]
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        here = counts[short] > k
        whole[here] = mix(whole[here] * np.uint64(0xD6E8FEB86659FD93) + words.hash[words.first[short[here]] + k] + np.uint64(k + 1))
    doc, value = np.concatenate([doc, short]), np.concatenate([value, whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(n + 1))


def _digest(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums of each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)))])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64))
    return out[0], out[1]


def _signatures(bands: int, rows: int, size: int):
    rng = np.random.default_rng(11)
    xor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            value, offsets = shingles(batch.column(1), size)
            count = np.diff(offsets)
            full = np.flatnonzero(count)
            out = np.zeros((len(full), bands), np.uint64)
            for band in range(bands):
                held = np.full(len(full), band, np.uint64)
                for k in range(band * rows, band * rows + rows):
                    least = np.minimum.reduceat((value ^ xor[k]) * factor[k], offsets[full]) if len(full) else np.zeros(0, np.uint64)
                    held = mix(held ^ least) + np.uint64(k)
                out[:, band] = held
            one, two = _digest(value, offsets)
            at = np.concatenate([[0], np.cumsum((count > 0) * bands)])
            columns = [batch.column(0), batch.column(2), pa.array(count, pa.int32()), pa.array(one), pa.array(two), list_array(out.astype(np.int64).ravel(), at)]
            yield pa.record_batch(columns, ["id", "h", "n", "s1", "s2", "bands"])

    return run


def _sets(size: int):
    """Rows of classes with their text become rows with their sorted set; a row with another text of that id goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, offsets = shingles(batch.column(batch.schema.get_field_index("text")), size)
            one, two = _digest(value, offsets)
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy()
            same = (one == column("s1")) & (two == column("s2"))
            raw = value.tobytes()
            sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
            kept = [c for c in batch.schema.names if c != "text"]
            out = pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], sets], [*kept, "shingles"])
            yield out.filter(pa.array(same))

    return run


def _common(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of the n sets that share an element, and how many they share."""
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    edge = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(value)))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, min(DENSE_FROM, int(size.max(initial=0))) + 1):
        own, (i, j) = edge[size == m], np.triu_indices(m, 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for at in range(0, len(own), step):
            held = owner[own[at : at + step, None] + np.arange(m)]
            key, count = np.unique(held[:, i].astype(np.int64) * n + held[:, j], return_counts=True)
            keys.append(key)
            counts.append(count)
    dense = np.flatnonzero(size > DENSE_FROM)
    if len(dense):
        total = np.zeros((n, n), np.float32)
        for at in range(0, len(dense), 2048):
            part = dense[at : at + 2048]
            has = np.zeros((n, len(part)), np.float32)
            rows = np.concatenate([owner[edge[k] : edge[k] + size[k]] for k in part])
            has[rows, np.repeat(np.arange(len(part)), size[part])] = 1
            total += has @ has.T
        i, j = np.nonzero(np.triu(total, 1))
        keys.append(i.astype(np.int64) * n + j)
        counts.append(total[i, j].astype(np.int64))
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key // n, key % n, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def _verified(threshold: float):
    """Verify the pairs of each (component, i, j): rows come sorted by these and are gathered group by group."""
    share = Fraction(str(threshold))

    def group(rows: list[tuple]) -> list[tuple]:
        # Rows: class, copies, block, shingles. Pairs within one block count only where the group is (i, i).
        ids = np.array([r[0] for r in rows])
        order = np.argsort(ids)
        rows, ids = [rows[k] for k in order], ids[order]
        copies, block = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets], np.int64)
        i, j, both = _common(np.concatenate(sets), np.repeat(np.arange(len(rows)), size), len(rows))
        linked = both * share.denominator >= (size[i] + size[j] - both) * share.numerator
        if block.min() != block.max():
            linked &= block[i] != block[j]
        i, j = i[linked], j[linked]
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        root, before = np.arange(len(rows)), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, j, root[i])
            np.minimum.at(root, i, root[j])
            root = root[root]
        return list(zip(ids.tolist(), ids[root].tolist(), links.astype(np.int64).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (pa.int64(), pa.int64(), pa.int64()), ["class", "root", "links"]
        key, held, done = None, [], []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("component", "i", "j", "class", "copies", "block", "shingles")]
            for c, i, j, *row in zip(*columns, strict=True):
                if (c, i, j) != key:
                    if len(held) > 1:
                        done += group(held)
                    key, held = (c, i, j), []
                held.append(tuple(row))
            if len(done) > 10_000:
                yield out()
                done = []
        if len(held) > 1:
            done += group(held)
        if done:
            yield out()

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = BAND_ROWS, size: int = SHINGLE) -> DataFrame:
    """id, h (hash of the text), class_id, n_links, group_size of each row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bands = choose_bands(threshold, recall, rows)
    hashed = texts.withColumn("h", F.xxhash64("text"))
    signed = materialise(hashed.mapInArrow(_signatures(bands, rows, size), "id long, h long, n int, s1 long, s2 long, bands array<long>"), "minhash")
    usable = signed.where("id is not null and n > 0")
    copies = usable.groupBy(*_KEY).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    copies = materialise(copies.withColumn("class", F.monotonically_increasing_id()), "classes")

    placed = copies.select("class", F.explode("bands").alias("band"))
    met = attach_stats(placed, ["band"], [F.min("class").alias("lo"), F.count("*").alias("c")], F.col("class"), having=F.col("c") > 1)
    candidates = connected_components(met.where("lo < class").select(F.col("lo").alias("a"), F.col("class").alias("b")).distinct())

    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = materialise(candidates.join(copies.drop("bands"), candidates["node"] == copies["class"]).drop("node"), "candidates")
    members = attach_stats(members, ["component"], [F.count("*").alias("m"), F.sum("n").alias("total")], F.col("class"))
    members = members.select(*_KEY, "id", "class", "copies", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("class"), blocks).cast("int").alias("block"))
    members = materialise(members, "members")
    # Always shuffled, small or large: what is read of the members grows with the texts.
    fetched = texts.hint("merge").join(members, "id").select("class", "text", *_KEY, "copies", "component", "blocks", "block").mapInArrow(
        _sets(size), "class long, s1 long, s2 long, n int, copies long, component long, blocks int, block int, shingles binary",
    ).dropDuplicates(["class"])
    dealt = fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "copies", "block", "shingles",
    )
    verified = (
        dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
        .mapInArrow(_verified(threshold), "class long, root long, links long")
    )
    verified = materialise(verified, "verified")

    joined = connected_components(verified.where("root <> class").select(F.col("root").alias("a"), F.col("class").alias("b")).distinct())
    links = verified.groupBy("class").agg(F.sum("links").alias("links"))
    table = copies.drop("bands").join(links, "class", "left").join(joined, F.col("class") == F.col("node"), "left")
    table = table.select(*_KEY, F.coalesce("component", "class").alias("group"), "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    table = attach_stats(materialise(table, "links"), ["group"], [F.min("id").alias("class_id"), F.sum("copies").alias("group_size")], F.col("s1")).drop("group", "id")
    out = attach(usable.drop("bands"), materialise(table, "groups"), _KEY, F.col("id"), rows="copies").select("id", "h", "class_id", "n_links", "group_size")
    alone = signed.where("id is null or n = 0").select("id", "h", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("group_size"))
    return out.union(alone)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, group_size (documents of the class)."""
    return _classes(docs, id_col, text_col, **params).select(F.col("id").alias("doc_id"), "class_id", "n_links", "group_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their class; rows with a null id stay, as do all rows that share the smallest id."""
    decided = _classes(docs, id_col, text_col, **params)
    gone = materialise(decided.where("class_id <> id").select(F.col("id").alias("_gone"), "h").distinct(), "near-duplicates")
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (F.xxhash64(docs[text_col]) == gone["h"]), "left_anti")
