"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from contraspark.llm import ann, common, exact_dedup, jaccard_join, license_scan, packing, substring_dedup, toxicity, url_filter, warc
from contraspark.llm import sentencepiece_codec as spc
from contraspark.llm.common import shared_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept_text string, name string"
LONG = "word " * 3000 + "x" * 5000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (None, "a b c d e f " * 4), (2, "a b c d e f " * 4), (2, "A b c d e f " * 4), (3, "x y"), (4, "x Y"), (5, ""), (6, LONG), (7, LONG), (7, LONG), (8, "É ﬁ \x00 \x1f q"), (9, "\n\t ")]
    return spark.createDataFrame([(i, t, "k", None) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pairs_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# ---- 1 -------------------------------------------------------------------------------------------


def test_sentencepiece_ids_are_those_of_the_library(spark, docs, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, library = spc.load_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, odd):
        out = spc.codec_report(df, model).collect()
        want = collections.Counter((i, tuple(library.encode(t or ""))) for i, t in pairs_of(df))
        assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want and all(r["round_trip"] for r in out)
    random.seed(1)
    texts = ["".join(random.choice("abThon ▁éЖ日\n.0") for _ in range(random.randint(0, 30))) for _ in range(3000)] + [" " * n + "x" for n in range(20)]
    ids, at = spc.Encoder(model).encode(pa.array(texts))
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == library.encode(texts)
    assert spc.codec_report(odd.limit(0), model).count() == 0
    # Columns named like the results are replaced, others kept; ids decode to the text, null arrays to nothing.
    clash = odd.select("doc_id", "text", F.lit("k").alias("ids"), F.lit(1).alias("decoded"), F.lit(2).alias("n_ids"))
    coded = spc.decode(spc.encode(clash, model), model)
    assert coded.columns == ["doc_id", "text", "n_ids", "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in coded.collect()) and spc.codec_report(clash, model).count() == odd.count()
    lists = [None, [], [None, 0x48 + 3], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9], [0], *[library.encode(t) for t in texts[:50]]]
    got = [r["decoded"] for r in spc.decode(spark.createDataFrame([(x,) for x in lists], "ids array<int>").coalesce(1), model).collect()]
    want = ["", "", "H", "\ufffd", "é", " ⁇ ", *[t.replace("▁", " ") for t in texts[:50]]]
    assert [t.removeprefix(" ") for t in got] == [t.removeprefix(" ") for t in want]


def test_unigram_viterbi_is_the_best_segmentation():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("ba", -5.0, 1), ("aba", -8.1, 1), ("▁a", -4.2, 1), ("▁ab", -6.9, 1)]
    model, score = spc.build_model(pieces, bpe=False), {p: s for p, s, k in pieces if k == 1}

    def best(word):
        if not word:
            return 0.0
        return max((score[word[:i]] + best(word[i:]) for i in range(1, len(word) + 1) if word[:i] in score), default=-1e9)

    random.seed(2)
    for _ in range(200):
        word = "".join(random.choice("ab") for _ in range(random.randint(1, 9)))
        ids, _ = spc.Encoder(model).encode(pa.array([word]))
        got = [pieces[i][0] for i in ids]
        assert "".join(got) == "▁" + word and abs(sum(score[p] for p in got) - best("▁" + word)) < 1e-9


# ---- 2 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("params", [{}, {"block_bytes": 64}, {"block_bytes": 512, "hash_bits": 5}])
def test_exact_dedup(docs, odd, params):
    for df in (docs, odd):
        groups = collections.defaultdict(list)
        for i, t in pairs_of(df):
            groups[lowered(t)].append(i)
        out = exact_dedup.exact_dedup(df, **params).collect()
        assert len(out) == df.count() and sum(r["kept"] for r in out) == len(groups)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): own for t, own in groups.items()}
        for r in out:
            own = by_sha[r["text_sha256"]]
            assert r["group_size"] == len(own) and r["keep_id"] == max((i for i in own if i is not None), default=None)
        assert len({(r["level"], r["name"]) for r in out}) == len(groups)


def test_drop_exact_duplicates(odd):
    out = exact_dedup.drop_exact_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"], lowered(r["text"])) for r in out.collect()) == sorted([(2, "a b c d e f " * 4), (4, "x y"), (5, ""), (7, LONG.lower()), (8, lowered("É ﬁ \x00 \x1f q")), (9, "\n\t ")])
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


# ---- 3 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    big, text = "payload " * 300, "WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "u", big), (2, None, big), (3, "u\r\nx", "small"), (4, "u", "small"), (None, "u", big), (None, "u", "other " * 400), (5, "u", None), (2, "u", big), (6, "u", text * 50)]
    df = spark.createDataFrame(rows, "id long, uri string, html string").withColumn("payload", F.encode("html", "UTF-8")).drop("html")
    path = shared_path(spark, "warc")
    warc.write_warc(warc.plan_revisits(df, "id", "payload"), path, compress, run_bytes=2000, runs_per_file=2)
    out = warc.resolve_revisits(warc.read_warc(spark, path)).collect()
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        revisit = t == big and i != 2
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert warc.resolve_revisits(warc.read_warc(spark, path).limit(0)).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(compress):
    records = [warc._record(i, "u", f"text {i} ".encode() * 200, "response", None) for i in range(6)]
    stored = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in records]
    stored = [z.compress(r) + z.flush() for z, r in zip(stored, records, strict=True)] if compress else records
    whole = b"".join(stored)
    assert [x[4] for x in warc.read_records(whole)] == [None] * 6
    broken = bytearray(whole)
    at = len(stored[0]) + len(stored[1])
    broken[at + 40 : at + 60] = b"\x07" * 20
    cut = len(whole) - len(stored[5]) // 2
    found = list(warc.read_records(bytes(broken[:cut])))
    good = [x[2]["warc-record-id"] for x in found if x[4] is None]
    assert good == [f"<urn:row:{i}>" for i in (0, 1, 3, 4)]
    gaps = [(x[0], x[1]) for x in found if x[4]]
    assert (at, len(stored[2])) in gaps and sum(n for _, n in gaps) == len(stored[2]) + cut - sum(map(len, stored[:5]))
    assert sum(x[1] for x in found) == cut


def test_damaged_archives_through_spark(spark, tmp_path):
    """Damage to a digest, a header and a compressed member: other records are read, gaps are logged, a revisit without its response keeps its digest."""
    import glob

    big = "payload " * 300
    rows = [(i, None, big if i in (3, 9) else f"text {i} " * 100) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, uri string, html string").select("id", "uri", F.encode("html", "UTF-8").alias("payload"), F.lit("x").alias("gap_reason"), F.lit(1).alias("_key"))
    for compress in (True, False):
        path = shared_path(spark, "warc")
        warc.write_warc(warc.plan_revisits(df.coalesce(1), "id", "payload"), path, compress)
        (name,) = glob.glob(path.removeprefix("file://") + "/part-*")
        data = open(name, "rb").read()
        starts = {int(x[2]["warc-record-id"].strip("<>").rsplit(":", 1)[1]): x[0] for x in warc.read_records(data)}
        broken, cut = bytearray(data), starts[9]
        if compress:
            broken[cut + 30 : cut + 40] = b"\x07" * 10
            expected = 1
        else:
            at = data.index(b"text 5 ", starts[5])
            broken[at : at + 4] = b"TEXT"  # the payload no longer has its digest
            at = data.index(b"Content-Length", starts[6])
            broken[at : at + 14] = b"Kontent-Length"  # a mandatory field is missing
            broken[cut : cut + 4] = b"XXXX"  # no version line
            expected = 2  # records 5 and 6 are one gap
        (tmp_path / str(compress)).mkdir()  # a folder without the checksums of the undamaged file
        (tmp_path / str(compress) / "damaged.warc").write_bytes(bytes(broken))
        found = warc.read_warc(spark, f"file://{tmp_path}/{compress}")
        gaps = found.where("gap_reason is not null").collect()
        assert len(gaps) == expected and all(g["length"] > 0 for g in gaps)
        out = {r["id"]: r for r in warc.resolve_revisits(found).collect()}
        assert out.keys() == set(range(10)) - ({9} if compress else {5, 6, 9})
        digest = hashlib.sha1(big.encode()).hexdigest()
        assert (out[3]["record_type"], out[3]["refers_to"], out[3]["payload_bytes"], out[3]["payload_digest"]) == ("revisit", 9, None, digest)


def test_salvage_takes_time_in_proportion():
    import time

    record = warc._record(1, "u", bytes(range(256)) * 40, "response", None)
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = member.compress(record) + member.flush()

    def took(n):
        data, began = member * n, time.process_time()
        assert sum(x[4] is None for x in warc.read_records(data)) == n
        return time.process_time() - began

    took(500)
    assert took(8000) < 12 * took(2000)


# ---- 4 -------------------------------------------------------------------------------------------


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = words(lowered(t))
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least[find(k)]) if least[find(k)] is not None else i
    return collections.Counter((str(i), str(least[find(k)] if i is not None else None), links[k]) for k, (i, _) in enumerate(rows))


def test_jaccard(docs, odd, monkeypatch):
    for df in (docs, odd):
        got = collections.Counter((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.jaccard_classes(df).collect())
        assert got == brute_jaccard(pairs_of(df))
    assert jaccard_join.jaccard_classes(odd.limit(0)).count() == 0


def test_jaccard_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 10)
    monkeypatch.setattr(jaccard_join, "DENSE_FROM", 4)
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.jaccard_classes(df).collect())
    assert got == brute_jaccard(rows)
    assert jaccard_join.drop_near_duplicates(df).count() == len({k[1] for k in got})


# ---- 5 -------------------------------------------------------------------------------------------


def brute_substring(rows, n=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[p : p + n])] = min(i, first.get(tuple(w[p : p + n]), i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if i is not None and first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return collections.Counter(out)


def test_substring_dedup(spark, docs, odd):
    random.seed(4)
    passage = [f"p{i}" for i in range(40)]
    made = []
    for i in range(80):
        w = [random.choice("abcdef") for _ in range(random.randint(0, 60))]
        a = random.randint(0, 27)
        at = random.randint(0, len(w))
        made.append((i, " ".join(w[:at] + passage[a : a + random.randint(11, 20)] + w[at:])))
    for df in (docs, odd, spark.createDataFrame(made, "doc_id long, text string")):
        out = substring_dedup.substring_dedup(df)
        got = collections.Counter((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect())
        assert got == brute_substring(pairs_of(df))
        assert all(sum(s["end"] - s["start"] for s in r["removed_spans"]) == r["n_removed"] for r in out.collect())
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


def test_columns_of_any_name_are_kept(spark, odd):
    """Columns named like the results or the operators' own ones change nothing and cause no failure."""
    names = ["id", "text2", "_text", "_hits", "_copied", "_of", "c0", "c1", "_first", "_id", "_sha", "_toxicity", "score", "ids", "decoded", "h", "class", "_gone", "n_removed", "_k0", "_s1"]
    clash = odd.select("doc_id", "text", *[F.lit(f"was {c}").alias(c) for c in names])
    out = substring_dedup.substring_dedup(clash)
    assert out.columns == ["doc_id", "text", *[c for c in names if c != "n_removed"], *substring_dedup.RESULTS]
    assert collections.Counter((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()) == brute_substring(pairs_of(odd))
    for kept in (exact_dedup.drop_exact_duplicates(clash), jaccard_join.drop_near_duplicates(clash)):
        rows = kept.collect()
        assert kept.columns == clash.columns and rows and all(r["_first"] == "was _first" and r["h"] == "was h" for r in rows)
    assert packing.pack(clash, public_tokenizers.path("word_bpe_49k.json")).where("start = 0").agg(F.count("*")).first()[0] == odd.count()
    assert license_scan.license_scan(clash).count() == odd.count()


def test_every_offset_pair_shares_a_cover_position():
    for a in range(substring_dedup.PERIOD):
        for b in range(substring_dedup.PERIOD):
            assert any((a + k) % 7 in substring_dedup.COVER and (b + k) % 7 in substring_dedup.COVER for k in range(7))


# ---- 6 -------------------------------------------------------------------------------------------


def test_url_rules_and_templates(spark):
    rows = [(1, "http://a.EXAMPLE.org/es/1"), (2, "x://example.org/en/12?q"), (3, "http://example.org/en/2#f"), (4, "http://b.com/de/7"), (5, None), (6, "nothing"), (7, "http://"), (7, "http://notexample.org"), (None, "http://k.net/a/b/c/d/e/f/g")]
    rows += [(100 + i, f"http://shop.com/{'de' if i % 2 else 'en'}/{w}") for i in range(40) for w in ("x", f"name{chr(97 + i % 26)}{chr(97 + i // 26)}")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    out = {(r["page_id"], r["path"]): r for r in url_filter.url_verdicts(df).collect()}
    assert len(url_filter.url_verdicts(df).collect()) == len(rows)
    assert out[1, "/es/1"]["rule"] == "example.org/es/" and out[1, "/es/1"]["verdict"] == "block" and out[1, "/es/1"]["host"] == "a.example.org"
    assert out[2, "/en/12"]["verdict"] == "block" and out[3, "/en/2"]["rule"] == "org/" and out[4, "/de/7"]["verdict"] == "block"
    assert out[5, ""]["host"] == "" and out[5, ""]["rule"] is None and out[7, ""]["verdict"] in ("allow", "block")
    assert out[100, "/en/nameaa"]["template"] == "/en/*"  # more than 16 different names below a node
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def merged_by_hand(counts):
    """Final template of each template {tuple: (n, b)} of one host, node by node from the last segment to the first."""
    final = {t: t for t in counts}
    for level in reversed(range(max(map(len, counts)))):
        own, node = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
        for t, now in final.items():
            groups = [own[now]] + ([node[now[:level], now[level + 1 :]]] if len(now) > level and now[level] != "*" else [])
            for g in groups:
                g[0] += counts[t][0]
                g[1] += counts[t][1]
        for t, now in final.items():
            if len(now) > level and now[level] != "*":
                (n, b), (nn, bb) = own[now], node[now[:level], now[level + 1 :]]
                if n * bb * (nn - bb) == 0 and b * nn == bb * n or (b * nn - bb * n) ** 2 <= 3.841 * n * bb * (nn - bb):
                    final[t] = (*now[:level], "?", *now[level + 1 :])
    return final


@pytest.mark.parametrize("hot", [False, True])
def test_url_branches_merge_at_every_level(spark, monkeypatch, hot):
    if hot:  # every key is spread
        monkeypatch.setattr(common, "HOT_ROWS", 3)
        monkeypatch.setattr(common, "HOT_KEYS", 10**9)
        monkeypatch.setattr(url_filter, "HOT_ROWS", 3)
    share = {"news": 10, "blog": 10, "bad": 95, "worse": 90}
    paths = [f"/{a}/{b}/{c}/n{i}" for a, b, c in itertools.product(share, ("x", "y", "z"), ("p", "q", "7")) for i in range(3 + len(a) * len(b + c) % 11 * 4)]
    paths += ["/" + "w" * 100_000 + "/" + "v/" * 50_000] * 2

    def label(path):  # as the Spark expression below
        c = zlib.crc32(path.encode())
        return None if c % 5 == 0 else c // 5 % 100 < (97 if path.startswith("/news/z/") else share.get(path.split("/")[1], 50))

    crc, first = F.crc32("path"), F.split_part("path", F.lit("/"), F.lit(2))
    least = F.when(F.col("path").startswith("/news/z/"), 97).otherwise(F.coalesce(*[F.when(first == k, v) for k, v in share.items()], F.lit(50)))
    verdict = F.when(crc % 5 != 0, F.when(F.floor(crc / 5) % 100 < least, "block").otherwise("allow"))
    monkeypatch.setattr(url_filter, "rule_for", lambda host, path, rules: (F.lit(None).cast("string"), F.when(host == "h.com", verdict)))
    counts, of = collections.defaultdict(lambda: [0, 0]), {}
    for path in paths:
        of[path] = tuple("*" if re.search("[0-9]", x) else x for x in path[1:].split("/", 4))
        counts[of[path]][0] += label(path) is not None
        counts[of[path]][1] += label(path) is True
    final = merged_by_hand(dict(counts))
    rows = [(i, f"http://{h}{path}") for i, (h, path) in enumerate(itertools.product(("h.com", "free.net"), paths))]
    got = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(rows)))
    for r in got:
        want = final[of[r["path"]]] if r["host"] == "h.com" else tuple(x if x == "*" else "?" for x in of[r["path"]])  # without labels all merge
        assert (r["template"], r["merged_template"]) == ("/" + "/".join(of[r["path"]]), "/" + "/".join(want))
    merged = {m for t, m in final.items()}
    assert any(m[0] == "?" for m in merged) and any(m[0] != "?" and m[1] == "?" for m in merged)


# ---- 7 -------------------------------------------------------------------------------------------


def test_licenses(spark, odd):
    t = license_scan.TEMPLATES
    mit = t["MIT"].replace("sell copies", "sell many copies").upper()
    rows = [(1, f"intro words {mit} end {t['ISC']}"), (2, t["MIT-line"] + " text " + t["MIT-line"]), (3, "the of and to in " * 2000), (4, None), (5, ""), (6, "x " * 9000 + t["GPL-3.0-line"])]
    out = {r["doc_id"]: r["licenses"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x["license"] for x in out[1]] == ["MIT", "ISC"] and out[1][0]["coverage"] == 1.0 and out[1][0]["first_word"] == 2
    assert [x["license"] for x in out[2]] == ["MIT-line"] * 2 and out[3] == out[4] == out[5] == []
    assert out[6][0]["license"] == "GPL-3.0-line" and out[6][0]["first_word"] == 9000
    assert license_scan.license_scan(odd).count() == odd.count() and license_scan.license_scan(odd.limit(0)).count() == 0


def test_alignment_is_a_common_subsequence():
    random.seed(5)
    for _ in range(300):
        a, b = [[random.randint(0, 6) for _ in range(random.randint(0, 14))] for _ in range(2)]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


# ---- 8 -------------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    x[100:600] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (None, [1.0] * 16), (2004, [None] * 16), (0, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, leaf=32, probes=150, block=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, unit = np.append(np.arange(1500), 0), np.vstack([x, np.ones((1, 16))])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    hit = total = 0
    for q in range(50, 1500, 50):
        s = unit @ unit[q]
        order = [k for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:5]
        assert len(got[q]) == 5 and all(abs(sc - max(s[ids == v])) < 1e-9 or v == 0 for v, sc in got[q])
        hit, total = hit + len({ids[k] for k in order} & {v for v, _ in got[q]}), total + 5
    assert hit / total >= 0.9
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105] and [v for v, _ in got[150]] == [100, 101, 102, 103, 104]
    few = ann.nearest(df.where("vec_id in (1, 50)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(50, 1)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_forest_scans_a_small_share_of_clustered_vectors():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1000, 32))[rng.integers(0, 1000, 60_000)] + 0.5 * rng.standard_normal((60_000, 32))
    unit = ann._unit(x)
    forest = ann.fit_forest(unit[:16384], 9)
    leaf = forest.leaves(unit)
    assert np.array_equal(leaf[7:9], forest.leaves(unit[7:9])) and np.unique(leaf, return_counts=True)[1].max() < 2000
    found = scanned = 0.0
    for q in range(0, 60_000, 1000):
        near = unit @ unit[q]
        near[q] = -9
        candidate = np.isin(leaf, forest.probe(unit[q], 40)).any(1)
        found, scanned = found + candidate[np.argsort(-near)[:5]].mean() / 60, scanned + candidate.mean() / 60
    assert found >= 0.9 and scanned < 0.1
    assert ann.probes_for(1000) == ann.probes_for(50_000) == ann.PROBES and ann.probes_for(50_000 * 32) == ann.PROBES * 4


# ---- 9 -------------------------------------------------------------------------------------------


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["don't d'or l'été 'S 's x's9 ½a a½ 3rd Σας ΣΑΣ İx «a». b…c ﬁ e\u0301 =\u0338= a\u00a0b \u3000 日本語abc! 한국 \U0001f600x _a_b 12'tis"] * 2 + ["a.b,c;d" * 900, "word " * 9000, None, ""]
    marks = spark.createDataFrame([(None if k == 1 else k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    for df in (docs, odd, marks, odd.limit(0)):
        got, fill = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect():
            got[r["doc_id"]].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]))
            assert len(r["ids"]) == 4 * r["length"]
            fill[r["sequence_id"]].append((r["offset"], r["length"]))
        want = collections.defaultdict(list)
        for i, t in pairs_of(df):
            want[i].append(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]))
        assert got.keys() == want.keys()
        for i, own in want.items():
            # Rows of one id are told apart by their content: each piece is where its document has it, and all ids are there.
            assert sum(len(x) for _, x, _ in got[i]) == sum(map(len, own))
            assert all(any(len(w) == n and w[a : a + len(x)] == x for w in own) for a, x, n in got[i])
            if len(own) == 1:
                assert sum((x for _, x, _ in sorted(got[i])), ()) == own[0]
        for pieces in fill.values():
            pieces.sort()
            ends = [a + n for a, n in pieces]
            assert [a for a, _ in pieces] == [0, *ends[:-1]] and (ends[-1] == 4096 or ends[-1] & (ends[-1] - 1) == 0 and ends[-1] < 4096)


def test_packer_takes_the_level_of_least_squares():
    random.seed(7)
    packer, size = packing.Packer(window=32), {}
    done = []
    for k in range(400):
        size[k] = random.randint(1, 50)
        counts = packer.count.copy()
        s = size[k] % 32
        if s:
            growth = {}
            for level in [0, *np.flatnonzero(counts).tolist()]:
                if level + s <= 32:
                    after = counts.copy()
                    after[level] -= level > 0
                    if level + s < 32:
                        after[level + s] += 1
                    growth[level] = (after**2).sum()
            chosen = packer._level(s)
            # Of equal levels the fullest is taken, an open window before a new one.
            assert chosen == max(level for level, g in growth.items() if g == min(growth.values()))
        done += packer.place(k, np.full(size[k], k))
    done += packer.finish()
    got = collections.Counter()
    for k, _, ids, _, _ in done:
        got[k] += len(ids)
    assert dict(got) == size


# ---- 10 ------------------------------------------------------------------------------------------


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = toxicity.read_labels(spark, sf)
    out = toxicity.toxicity(docs, labels)
    assert out.count() == docs.count()
    m = out.join(labels, "doc_id").where("held_out").toPandas()
    rank, toxic = m.score.rank(), m.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.9 and ((m.predicted == 1) & ~toxic).sum() < 0.02 * (~toxic).sum()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.limit(200).collect())


def stated_risk(w, x, positive, prior, decay):
    """The clipped risk of a dense table and its gradient; the bias is the last weight and is not decayed."""
    out = x @ w[:-1] + w[-1]
    prob = 1 / (1 + np.exp(-out))
    p, u = positive, ~positive
    as_negative = np.log1p(np.exp(out))
    negative = as_negative[u].mean() - prior * as_negative[p].mean()
    one = np.column_stack([x, np.ones(len(x))])
    grad = -prior * ((1 - prob[p])[:, None] * one[p]).mean(0) + np.append(decay * w[:-1], 0)
    if negative >= 0:
        grad = grad + (prob[u][:, None] * one[u]).mean(0) - prior * (prob[p][:, None] * one[p]).mean(0)
    return prior * np.log1p(np.exp(-out[p])).mean() + max(0.0, negative) + decay / 2 * (w[:-1] ** 2).sum(), grad, negative


@pytest.mark.parametrize("prior", [0.1, 0.7])
def test_fit_follows_the_stated_risk(prior):
    rng = np.random.default_rng(3)
    x = rng.random((60, 7)) * (rng.random((60, 7)) < 0.5)
    positive = np.arange(60) < 20
    x[positive, 0] += 1
    x[:3] = 0  # texts without any known word
    row, place = np.nonzero(x)
    data = toxicity.Features(place, x[row, place], np.searchsorted(row, np.arange(61)))
    epochs, rate, decay = 40, 0.3, 1e-3
    got, bias = toxicity.fit_nnpu(data, positive, prior, 7, epochs=epochs, batch=64, rate=rate, decay=decay)
    w = np.append(np.zeros(7), np.log(prior / (1 - prior)))
    first = second = total = 0
    clipped = []
    for step in range(1, epochs + 1):  # all rows are one batch
        _, grad, negative = stated_risk(w, x, positive, prior, decay)
        if abs(negative) > 1e-3:
            slope = [(stated_risk(w + e, x, positive, prior, decay)[0] - stated_risk(w - e, x, positive, prior, decay)[0]) / 2e-6 for e in 1e-6 * np.eye(8)]
            assert np.allclose(grad, slope, atol=1e-7)
        clipped.append(negative < 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        total = total + (w if step > epochs // 2 else 0)
    mean = total / (epochs - epochs // 2)
    # The first gradient of the bias is zero but for rounding, which Adam's quotient raises to 1e-9.
    assert np.allclose(got, mean[:-1], rtol=0, atol=1e-6)
    assert abs(bias + toxicity._least_risk(x @ mean[:-1] + mean[-1], positive, prior) - mean[-1]) < 1e-6
    assert any(clipped) and not all(clipped)  # both branches of the risk were met


def test_telling_places_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i < 15, sorted(rng.choice(30, rng.integers(0, 9), replace=False).tolist())) for i in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, positive boolean, place array<int>")
    n, m = 15, 45
    found = {k: (sum(k in r[2] for r in rows if r[1]), sum(k in r[2] for r in rows if not r[1])) for k in range(30)}
    z = {k: abs(p / n - u / m) / (max((p + u) / 60 * (1 - (p + u) / 60), 1e-12)) ** 0.5 for k, (p, u) in found.items() if p + u > 1}
    for most in (5, 12, 99):
        want = sorted(sorted(z, key=lambda k: (-round(z[k], 12), k))[:most])
        place, scale = toxicity._telling_places(sample, {True: n, False: m}, most)
        assert place.tolist() == want and np.allclose(scale, [np.log(61 / (sum(found[k]) + 1)) for k in want])


def test_toxicity_of_positive_rows_only(spark):
    """Nothing contrasts with them: every text gets the prior as its score's place, no crash, one score for all."""
    docs = spark.createDataFrame([(i, f"word{i} bad") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)


def test_toxicity_odd_rows(spark, odd):
    none = toxicity.toxicity(odd, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in none.collect()} == {0.0} and none.count() == odd.count()
    labels = spark.createDataFrame([(i, 1 if i == 3 else None) for i in range(9)], "doc_id long, toxic int")
    some = toxicity.score(odd, toxicity.train(odd, labels))
    assert all(0 <= r["score"] <= 1 for r in some.collect()) and some.columns == [*odd.columns, "score"]
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_toxicity_ties_and_names(spark):
    """Equal texts get equal scores whatever their ids; columns named like the score are replaced; the 0/1 risk is the least by brute force."""
    rows = [(i, "bad vile words " * 4 if i % 4 == 0 else f"good kind words {i % 3} " * 4) for i in range(400)] + [(400, None), (401, ""), (None, "bad vile words " * 4), (8, "bad vile words " * 4)]
    docs = spark.createDataFrame([(i, t, 7.0, "s") for i, t in rows], "doc_id long, text string, score double, positive string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    assert out.columns == ["doc_id", "text", "positive", "score"]
    by_text = collections.defaultdict(set)
    for r in out.collect():
        by_text[r["text"] or ""].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert by_text["bad vile words " * 4].pop() >= 0.5 > max(by_text["good kind words 1 " * 4])
    rng = np.random.default_rng(9)
    for _ in range(50):
        x, positive, prior = rng.integers(0, 12, 60).astype(float), rng.random(60) < 0.3, 0.2
        risk = {c: prior * (x[positive] < c).mean() + max(0, (x[~positive] >= c).mean() - prior * (x[positive] >= c).mean()) for c in np.unique(x)}
        assert abs(risk[toxicity._least_risk(x, positive, prior)] - min(risk.values())) < 1e-12


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = toxicity.train(docs.where(~toxicity.held_out()), toxicity.read_labels(spark, SF).where(~toxicity.held_out()))
    clean = {r[0]: r[1] for r in toxicity.score(docs, weights).where("score < 0.5").select("doc_id", "text").collect()}
    first = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    assert first == set(clean)
    largest = {lowered(t): max(i for i, u in clean.items() if lowered(u) == lowered(t)) for t in clean.values()}
    kept = [(i, clean[i]) for i in sorted(largest.values())]
    classes = {}
    for (i, c, _), _ in brute_jaccard(kept).items():
        classes.setdefault(c, []).append(int(i))
    kept = [(i, t) for i, t in kept if i in {min(v) for v in classes.values()}]
    cut = {int(i): (n, r, t) for i, n, r, t in brute_substring(kept)}
    texts = {i: cut[i][2] if cut[i][1] else t for i, t in kept}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    out = corpus_pipeline.run(spark, SF).collect()
    got = collections.Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want and isinstance(pa.__version__, str)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, repeated and very long texts, null ids, extra columns with the stages' own names, and no rows at all."""
    text = "a b c d e f " * 4
    rows = [(1, None), (None, text), (2, text), (2, "A" + text[1:]), (3, "x y"), (4, "x Y"), (5, ""), (6, LONG), (7, LONG), (7, LONG), (9, "\n\t "), (10, " ".join(f"w{k}" for k in range(60))), (11, "start " + " ".join(f"w{k}" for k in range(20, 60)) + " end")]
    names = ["_toxicity", "kept_text", "n_removed", "_first", "id", "score"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, df = df.count(), stage(spark, df, str(tmp_path))
            assert df.columns == docs.columns and df.count() <= before, name
            assert all(tuple(r[n] for n in names) == tuple(names) for r in df.select(*names).collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of equal texts the largest id stays, of near copies the smallest; null and empty texts are one text.
    kept = [i for i, t in rows if i in (2, 4, 5, 7, 9, 10, 11)]
    assert {r["doc_id"] for r in out} == set(kept)
    assert collections.Counter(r["doc_id"] for r in out if r["start"] == 0) == collections.Counter(set(kept))
    assert {r["doc_id"]: r["doc_tokens"] for r in out}[11] < 20
