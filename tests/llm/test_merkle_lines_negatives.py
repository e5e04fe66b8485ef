"""Merkle manifests, line deduplication and hard negatives against brute force, with odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contraspark.llm import hard_negatives as hn
from contraspark.llm import line_dedup as ld
from contraspark.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i - i % 8
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        i //= 8
    return out


def expected_manifest(rows):
    """rows: (id, group, leaf) -> sorted list of (id, group, leaf, path, subroot, root)."""
    groups = {}
    for i, g, leaf in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for k, (_, _, leaf, i) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((i, g, leaf, siblings(trees[g], k) + siblings(top, at), trees[g][-1][0], top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(df):
    return sorted(((r.doc_id, r.lang, r.leaf, [tuple(s) for s in r.path], r.subroot, r.root) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        [(5, "en", "a")],
        [(i * 37 - 400, None if i % 5 == 0 else f"g{i % 3}", f"t{i}") for i in range(90)],
        [(None if i % 4 == 0 else i // 3, "en", f"t{i // 2}") for i in range(60)],
        [((i * 2654435761) % (1 << 62) - (1 << 61), f"é{i % 75}", f"t{i}") for i in range(150)] + [(-(1 << 63), "x", "l"), ((1 << 63) - 1, "x", "m"), (None, "x", "n")],
    ],
    ids=["lone", "groups", "repeats", "sparse"],
)
def test_manifest(spark, rows):
    rows = [(i, g, sha(t)) for i, g, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(3)
    assert manifest_rows(merkle.manifest(df)) == expected_manifest(rows)


def test_manifest_of_several_passes_and_other_columns(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.col("id").alias("k"), F.lit("x").alias("root"))
    out = merkle.manifest(df)
    assert out.columns == ["doc_id", "lang", "leaf", "k", "path", "subroot", "root"]
    want = expected_manifest([(i, "en", sha(str(i))) for i in range(9000)])
    assert manifest_rows(out) == want and len(want[0][3]) == 5
    folded = merkle.fold(F.col("path"), F.col("leaf"))
    assert out.where((folded == F.col("root")) & (F.col("k") == F.col("doc_id"))).count() == 9000
    assert out.where(merkle.fold(F.col("path"), F.sha2("leaf", 256)) == F.col("root")).count() == 0


def test_many_equal_rows_are_placed_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_COPIES", 16)
    rows = [(7, "en", sha("same"))] * 100 + [(7, "en", sha("other")), (3, "en", sha("z"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(4)
    assert manifest_rows(merkle.manifest(df)) == expected_manifest(rows)


def test_manifest_empty(spark):
    out = merkle.manifest(spark.createDataFrame([], "doc_id long, lang string, leaf string, more int"))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "leaf", "more", "path", "subroot", "root"]


def test_written_values(spark):
    row = spark.sql("SELECT CAST(NULL AS string) a, 'é' b, -5L c, '' d").select(merkle.digest(*map(F.col, "abcd")).alias("h")).first()
    assert row.h == sha("-2:é2:-50:")


WHITE = " \t\n\v\f\r"


def key_of(line):
    key = line.strip(WHITE)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def expected_lines(rows, chars=20, docs=3):
    low = -(1 << 63)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= chars:
                holders.setdefault(key_of(line), set()).add(low if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(h := holders.get(key_of(x), ())) >= docs and max(h) != (low if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def line_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in ld.apply(df).collect()), key=repr)


COMMON, RARE = "This very common line stands in most of them", "A line that two documents hold, and no more"


def line_docs():
    docs = [(i, "\n".join(["head of document number %d, its own line" % i, f" \t{COMMON if i % 2 else COMMON.upper()}\r", "short", f"ünï {i % 7} shared by every seventh text öäü", ""])) for i in range(60)]
    docs += [(100, f"{RARE}\n{RARE}"), (101, RARE), (102, None), (103, ""), (104, "\n\n"), (105, f"{COMMON}\n{COMMON}\n" + "x" * 100_000)]
    docs += [(None, f"{COMMON}\nnull id"), (None, COMMON), (7, COMMON + "\nanother text of seven"), (7, docs[7][1]), (105, "again\n" + COMMON)]
    return docs


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_lines(spark, parts):
    docs = line_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert line_rows(ld.line_dedup(df)) == expected_lines(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_line_in_every_document_over_many_ranges(spark):
    docs = [(i, f"{COMMON}\nown {i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert line_rows(ld.line_dedup(df)) == expected_lines(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_columns_and_bitmaps(spark):
    df = spark.createDataFrame([(i, f"{COMMON}\n{i}", "k", i) for i in range(4)], "doc_id long, text string, keep string, id int")
    out = ld.line_dedup(df)
    assert out.columns == ["doc_id", "text", "id", "n_lines", "n_dropped", "keep"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].keep is None and rows[0].id == 0 and ld.decode_bitmap(bytes(rows[0].keep), 2).tolist() == [False, True]
    assert ld.line_dedup(df.limit(0)).count() == 0
    assert len(ld.encode_bitmap(100_000, np.arange(10))) < 200 and zlib.decompress(ld.encode_bitmap(9, np.array([8])))[1] == 0


def expected_negatives(rows, anchor, positives=5, negatives=3):
    kept = []
    for at, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((at, i, label, [math.floor(256 * x) for x in v]))
    out = []
    for at, i, label, v in (r for r in kept if anchor(r[1])):
        score = {r[0]: sum(a * b for a, b in zip(v, r[3], strict=True)) for r in kept}
        own = sorted((-score[r[0]], r[1], r[0]) for r in kept if r[0] != at and r[2] == label)[:positives]
        for minus, p, _ in own:
            fits = sorted((-score[r[0]], r[1]) for r in kept if r[2] != label and -50 * minus <= 100 * score[r[0]] <= -95 * minus)[:negatives]
            out += [(i, p, rank + 1, n, -minus, -s) for rank, (s, n) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("dim,size,blocks", [(4, 1.0, (8192, 8192)), (4, 0.01, (2, 7)), (150, 300.0, (3, 16)), (3, 1e6, (8192, 8192)), (1, 5.0, (1, 1))])
def test_negatives(spark, dim, size, blocks):
    rng = np.random.default_rng(dim)
    rows = [(i, i % 3, (rng.standard_normal(dim) + 0.5).__mul__(size).tolist()) for i in range(60)]
    rows += [(10, 1, rows[10][2]), (11, 2, rows[20][2]), (None, 1, [1.0] * dim), (70, None, [1.0] * dim), (71, 1, None), (72, 1, [float("nan")] + [1.0] * (dim - 1)), (73, 1, [None] + [1.0] * (dim - 1)), (80, 1, [0.0] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    out = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), anchor_block=blocks[0], row_block=blocks[1])
    got = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == expected_negatives(rows, lambda i: i % 10 == 0) and (got or size < 1)


def test_scores_are_exact_up_to_their_bound():
    rng = np.random.default_rng(1)
    for dim, top in ((64, 512), (64, 1 << 27), (200, 1 << 20), (1, 1 << 30), (7, 0)):
        a, b = (rng.integers(-top, top + 1, (20, dim)) for _ in range(2))
        a[0], b[0], b[1] = top, top, -top
        bases = hn.moduli(max(1, dim * top * top))
        assert np.array_equal(hn.scores(hn.residues(a, bases), hn.residues(b, bases), bases), a @ b.T)
    assert hn.STRETCH * (hn.PRIME_LIMIT // 2) ** 2 <= 1 << 24


def test_negatives_of_odd_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    ask = lambda rows: hn.hard_negatives(spark.createDataFrame(rows, kind), F.col("vec_id") % 2 == 0, F.col("label"))
    assert ask([]).count() == 0
    assert ask([(1, 1, [1.0])]).count() == 0
    assert ask([(2, 1, [1.0]), (4, 1, [1.0])]).count() == 0
    assert ask([(2, 1, []), (4, 1, []), (5, 2, [])]).count() == 2  # scores of 0 are inside the window 0 to 0
    with pytest.raises(ValueError, match="64 bits"):
        ask([(2, 1, [3e30, 1.0]), (4, 1, [1.0, 1.0])])
