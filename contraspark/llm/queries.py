"""The registered queries of this folder: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contraspark.llm import ann, exact_dedup, hard_negatives, jaccard_join, license_scan, line_dedup, merkle, packing, sentencepiece_codec, substring_dedup, toxicity, url_filter, warc
from contraspark.llm.common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.codec_report(_table(spark, sf_dir, "documents"), model)


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    path = shared_path(spark, "warc")
    warc.write_warc(warc.plan_revisits(pages, "id", "payload"), path)
    return warc.resolve_revisits(warc.read_warc(spark, path, with_payload=False)).withColumnRenamed("id", "page_id")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    # The columns beside the array are those of the license of largest coverage.
    best = F.element_at(F.array_sort("licenses", lambda a, b: F.when(a["coverage"] > b["coverage"], -1).when(a["coverage"] < b["coverage"], 1).otherwise(0)), 1)
    return out.select("doc_id", "licenses", F.size("licenses").alias("n_licenses"), F.when(F.size("licenses") > 0, best).alias("best")).select(
        "doc_id", "n_licenses", F.col("best.license").alias("license"), F.col("best.coverage").alias("coverage"), F.col("best.first_word").alias("first_word"), F.col("best.end_word").alias("end_word"), "licenses",
    )


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), toxicity.read_labels(spark, sf_dir))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    lowered = F.when(F.col("text").isNotNull(), exact_dedup.normalised(F.col("text")))
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(chosen, F.unhex(leaf(lowered))).alias("tampered"))
    out = merkle.manifest(leaves)
    folded = merkle.fold(F.col("path"), F.coalesce(F.lower(F.hex("tampered")), "leaf"))
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.apply(line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece,
    "op2_exact_dedup": exact,
    "op3_warc": archives,
    "op4_ngram_jaccard": ngram_jaccard,
    "op5_substring_dedup": substrings,
    "op6_url_filter": urls,
    "op7_license_scan": licenses,
    "op8_nearest": neighbours,
    "op9_packing": packed,
    "op10_toxicity": toxic,
    "op11_merkle_manifest": manifest,
    "op12_line_dedup": lines,
    "op13_hard_negatives": negatives,
}

_LOWERED_OR_NULL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: A value with its UTF-8 byte count.
_WRITTEN = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 11))) AS i FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM i),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM f WHERE lo < doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS t, count(*) AS n FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.k = c.k WHERE c.k IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op6_url_filter": url_filter.verdict_sql(),
    "op11_merkle_manifest": f"""
WITH RECURSIVE v AS (SELECT doc_id, lang, unnest([text, {_LOWERED_OR_NULL}]) AS t, unnest([0, 1]) AS k, source, n_chars FROM documents),
h AS (SELECT doc_id, lang, k, sha256({" || ".join(_WRITTEN.format(c) for c in ("doc_id", "source", "lang", "n_chars", "t"))}) AS h FROM v),
-- CRC-32 of the decimal id: the reflected polynomial, bit by bit.
c AS (SELECT DISTINCT doc_id, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, b:
  list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END, xor(s, b)), 4294967295::BIGINT)) % 3 = 0 AS hit FROM documents WHERE doc_id IS NOT NULL),
leaf AS (SELECT a.doc_id, a.lang, a.h, CASE WHEN c.hit THEN b.h ELSE a.h END AS other,
  row_number() OVER (PARTITION BY a.lang ORDER BY a.doc_id NULLS FIRST, a.h) - 1 AS i, count(*) OVER (PARTITION BY a.lang) AS n
  FROM (SELECT * FROM h WHERE k = 0) a JOIN (SELECT * FROM h WHERE k = 1) b ON a.doc_id IS NOT DISTINCT FROM b.doc_id LEFT JOIN c ON a.doc_id = c.doc_id),
up AS (SELECT lang, 0 AS level, i, h, n FROM leaf
  UNION ALL SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, i // 8, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, i, h, n FROM sub
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8, n),
path AS (SELECT doc_id, h AS leaf, lang, 0 AS level, i, i AS own, other AS f, '' AS sib, n FROM leaf
  UNION ALL SELECT p.doc_id, p.leaf, p.lang, p.level + 1, p.i // 8, p.own, sha256(string_agg(CASE WHEN u.i = p.i THEN p.f ELSE u.h END, '' ORDER BY u.i)),
    p.sib || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> p.i), ''), (p.n + 7) // 8
  FROM path p JOIN up u ON p.lang IS NOT DISTINCT FROM u.lang AND p.level = u.level AND p.i // 8 = u.i // 8 WHERE p.n > 1
  GROUP BY p.doc_id, p.leaf, p.lang, p.level, p.i, p.own, p.f, p.sib, p.n),
over AS (SELECT p.doc_id, p.leaf, p.lang, p.own, s.h AS subroot, 0 AS level, s.i, p.f, p.sib, s.n FROM path p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang WHERE p.n = 1
  UNION ALL SELECT p.doc_id, p.leaf, p.lang, p.own, p.subroot, p.level + 1, p.i // 8, sha256(string_agg(CASE WHEN u.i = p.i THEN p.f ELSE u.h END, '' ORDER BY u.i)),
    p.sib || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> p.i), ''), (p.n + 7) // 8
  FROM over p JOIN top u ON p.level = u.level AND p.i // 8 = u.i // 8 WHERE p.n > 1
  GROUP BY p.doc_id, p.leaf, p.lang, p.own, p.subroot, p.level, p.i, p.f, p.sib, p.n)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM over, (SELECT h FROM top WHERE n = 1) t WHERE over.n = 1""",
    "op12_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (top IS NULL OR top = doc_id) AS t, count(*) FILTER (top <> doc_id) AS n_dropped, count(*) AS n_lines FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM g""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT s.a, p, ps, b, s, row_number() OVER (PARTITION BY s.a, p ORDER BY s DESC, b) AS rank FROM s JOIN p ON s.a = p.a WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE rank <= 3""",
}
