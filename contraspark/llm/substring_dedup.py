"""Removal of repeated word sequences, found by difference-cover anchors.

Two places that share ``window`` words share, whatever their positions, an anchor of
``window - period + 1`` words that starts at a cover position of both: for any two offsets modulo the
period there is one shift below the period that brings both into the cover. So only windows at cover
positions (3 of 7) are hashed and shuffled in the first step; anchors of one document alone are
dropped. Then matches are extended: where a document has a shared anchor, the full windows around it
are hashed and compared, and a window counts as repeated when it also starts in a document with a
smaller id. Texts whose whole word sequence a smaller id has too lose all their words at once and are
left out of these steps. Every word has two independent 64-bit hashes; windows are compared by 96 bits
made of both, whole sequences by 128.

Words are the maximal runs of characters other than ASCII space and \\t \\n \\v \\f \\r, unchanged. Windows
are judged on the input. No pairs of documents are made: each step looks up the smallest id of an
anchor's or window's documents, so a passage that thousands of documents share costs one row for each.

Defined cases: null texts have no words; texts shorter than the window lose nothing. Rows with a null
id lose nothing and are no source; rows with the same id are one document as a source and do not
remove each other's words. Repeated rows lose the same words. Texts of any length are read as a whole.
Columns named like the results (kept_text, n_words, n_removed, removed_spans) are replaced, all others
kept, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraspark.llm.common import attach_stats, list_array, slices
from contraspark.llm.words import Words, mix, run_starts, runs, split_words

WINDOW = 13
PERIOD, COVER = 7, (1, 2, 4)
RESULTS = ["kept_text", "n_words", "n_removed", "removed_spans"]


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word (in its document) and hash of the anchors at cover positions of long enough documents."""
    size = window - PERIOD + 1
    starts, offsets = run_starts(words.first, size)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(offsets))
    pos = starts - words.first[doc]
    keep = np.isin(pos % PERIOD, COVER) & (np.diff(words.first)[doc] >= window)
    starts, doc, pos = starts[keep], doc[keep], pos[keep]
    return doc, pos, (runs(words.hash, size)[starts] >> np.uint64(16)).astype(np.int64)


def _distinct(doc: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((*values[::-1], doc))
    columns = [x[order] for x in (doc, *values)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(order) else False
    return [c[new] for c in columns]


def _offsets(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in all words), their offsets by document, and the two hashes of all windows."""
    starts, offsets = run_starts(words.first, window)
    one = runs(words.hash, window)[starts].astype(np.int64)
    two = (runs(words.second, window)[starts] >> np.uint64(32)).astype(np.int32)
    return starts, offsets, one, two


def _digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each text's whole word sequence; the order counts."""
    place = mix((np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first))).astype(np.uint64) + np.uint64(1))
    out = []
    for hashes in (words.hash, words.second):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ place))])
        out.append(mix(sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.int64))
    return out[0], out[1]


def _emit_digests(window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words = split_words(batch.column(1), two=True)
            one, two = _digests(words)
            out = pa.record_batch([batch.column(0), pa.array(one), pa.array(two)], ["id", "d1", "d2"])
            yield out.filter(pa.array(np.diff(words.first) >= window))

    return run


def _is_copy(words: Words, known: pa.Array) -> np.ndarray:
    """Rows whose digests are among those of their id's rows that copy a smaller id."""
    out = np.zeros(len(known), bool)
    some = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
    if len(some):
        one, two = _digests(words)
        for i in some.tolist():
            out[i] = {"d1": one[i], "d2": two[i]} in known[i].as_py()
    return out


def _emit_anchors(window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words = split_words(batch.column(1), two=True)
            skip = _is_copy(words, batch.column(2)) | ~batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc, _, anchor = _anchors(words, window)
            own = ~skip[doc]
            doc, anchor = _distinct(doc[own], anchor[own])
            yield pa.record_batch([batch.column(0), list_array(anchor, _offsets(doc, batch.num_rows))], ["id", "anchors"])

    return run


def _emit_windows(window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole.filter(whole.column(2).is_valid())], text_col):
                n, words, shared = batch.num_rows, split_words(batch.column(1), two=True), batch.column(2)
                doc, pos, anchor = _anchors(words, window)
                bounds, have = shared.offsets.to_numpy(), shared.values.to_numpy()
                hit = np.zeros(len(doc), bool)
                edge = _offsets(doc, n)
                for i in range(n):
                    lo, hi = edge[i], edge[i + 1]
                    hit[lo:hi] = np.isin(anchor[lo:hi], have[bounds[i] : bounds[i + 1]])
                starts, offsets, one, two = _windows(words, window)
                count = np.diff(offsets)
                # A window is looked at when an anchor starts in its first PERIOD words.
                mark = np.zeros(len(starts) + 1, np.int64)
                d, p = doc[hit], pos[hit]
                low, high = np.maximum(0, p - PERIOD + 1), np.minimum(p, count[d] - 1)
                ok = low <= high
                np.add.at(mark, offsets[d[ok]] + low[ok], 1)
                np.add.at(mark, offsets[d[ok]] + high[ok] + 1, -1)
                chosen = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                of = np.searchsorted(offsets, chosen, "right") - 1
                of, one, two = _distinct(of, one[chosen], two[chosen])
                at = _offsets(of, n)
                yield pa.record_batch([batch.column(0), list_array(one, at), list_array(two, at)], ["id", "w1", "w2"])

    return run


def _remove(window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            n, names = batch.num_rows, batch.schema.names
            words = split_words(batch.column(names.index(text_col)), two=True)
            hits = batch.column(names.index("_hits"))
            starts, offsets, one, two = _windows(words, window)
            cover = np.zeros(len(words.start) + 1, np.int64)
            for i in np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False)).tolist():
                have = hits[i].values
                lo, hi = offsets[i], offsets[i + 1]
                known = np.rec.fromarrays([have.field(0).to_numpy(), have.field(1).to_numpy()])
                known.sort()
                at = np.flatnonzero(np.isin(one[lo:hi], known["f0"]))
                if len(at):
                    own = np.rec.fromarrays([one[lo:hi][at], two[lo:hi][at]], dtype=known.dtype)
                    at = at[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own]
                    first = starts[lo + at]
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + window, -1)
            doc = words.document()
            copy = _is_copy(words, batch.column(names.index("_copied")))
            gone = (np.cumsum(cover[:-1]) > 0) | copy[doc]
            n_words, n_removed = np.diff(words.first), np.bincount(doc[gone], minlength=n)
            # Kept words, each followed by a space; the last space of a text is cut off.
            keep = np.flatnonzero(~gone)
            size = words.end[keep] - words.start[keep] + 1
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out = np.append(words.raw, np.uint8(32))[np.minimum(np.arange(total) + np.repeat(words.start[keep] - (ends - size), size), len(words.raw))]
            out[ends - 1] = 32
            per_text = np.concatenate([[0], ends])[np.searchsorted(doc[keep], np.arange(n + 1))]
            raw = out.tobytes()
            texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist(), strict=True)]
            spans = [[] for _ in range(n)]
            for i in np.flatnonzero(n_removed).tolist():
                a, b = words.first[i], words.first[i + 1]
                own = np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)
                spans[i] = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True)]
            kept = [c for c in names if c not in ("_hits", "_copied")]
            made = [pa.array(texts, pa.string()), pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in kept], *made], [*kept, *RESULTS])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with kept_text (kept words joined by one space), n_words, n_removed and removed_spans (word positions)."""
    if window < PERIOD:
        raise ValueError(f"windows of {PERIOD} words at least")
    docs = docs.drop(*RESULTS)
    # Columns go by their number inside, so that no name of the table can clash with one of these.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    # Exact copies of a smaller id's words are settled as a whole: they lose all words and are no source.
    whole = plain.where(F.col(own).isNotNull()).select(own, text).mapInArrow(_emit_digests(window, text), "id long, d1 long, d2 long")
    copies = attach_stats(whole, ["d1", "d2"], [F.min("id").alias("lo"), F.max("id").alias("hi")], F.col("id"), having=F.col("lo") < F.col("hi"))
    copies = copies.where("lo < id").groupBy("id").agg(F.collect_set(F.struct("d1", "d2")).alias("_copied"))

    # Whole rows are joined in each step, though the first two need the texts alone: so all share one shuffle of the table.
    rest = [c for c in plain.columns if c not in (own, text)]
    beside = lambda found: plain.join(found.withColumnRenamed("id", "_of"), F.col(own) == F.col("_of"), "left").drop("_of")
    anchors = beside(copies).select(own, text, "_copied", *rest).mapInArrow(_emit_anchors(window, text), "id long, anchors array<long>")
    anchors = anchors.select("id", F.explode("anchors").alias("a"))
    by_anchor = Window.partitionBy("a")
    shared = (
        anchors.select("id", "a", F.min("id").over(by_anchor).alias("lo"), F.max("id").over(by_anchor).alias("hi"))
        .where("lo < hi").groupBy("id").agg(F.collect_list("a").alias("anchors"))
    )
    around = beside(shared).select(own, text, "anchors", *rest).mapInArrow(_emit_windows(window, text), "id long, w1 array<long>, w2 array<int>")
    windows = around.select("id", F.explode(F.arrays_zip("w1", "w2")).alias("w")).select("id", "w.w1", "w.w2")
    repeated = windows.select("id", "w1", "w2", F.min("id").over(Window.partitionBy("w1", "w2")).alias("lo")).where("lo < id")
    hits = repeated.groupBy("id").agg(F.collect_list(F.struct("w1", "w2")).alias("_hits"))
    joined = beside(hits)
    joined = joined.join(copies.withColumnRenamed("id", "_of"), F.col(own) == F.col("_of"), "left").select(*plain.columns, "_hits", "_copied")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kinds = [T.StringType(), T.LongType(), T.LongType(), span]
    schema = T.StructType([*plain.schema.fields, *[T.StructField(c, k) for c, k in zip(RESULTS, kinds, strict=True)]])
    return joined.mapInArrow(_remove(window, text), schema).toDF(*docs.columns, *RESULTS)
