"""URL verdicts from per-host path-template trees, in DataFrame operations only.

Rules decide the urls they fit and label them. For the other urls each host's paths form a tree:

* a segment with a digit is a wildcard; so is, level by level, every segment below a node that has
  more than ``max_branch`` different children (deeper levels are counted below the wildcards already
  found). Segments past ``depth`` are one last segment.
* the tree is then merged bottom-up: at each level, from the last to the first, templates of a host that
  differ in a literal segment there only are branches of one node. A branch whose share of blocked labels
  does not differ significantly from that of all of the node's branches (chi-square, one degree of freedom,
  5 %) gets "?" for the segment, which no path can hold, so such branches are one template at the levels
  above; unlabelled branches always do.
* the share of blocked labels of a merged template is smoothed with ``alpha`` pseudo-labels at its
  host's share, which is smoothed likewise with the share among all labels. Templates whose smoothed
  share is a half or more are rejected.

The tree is made of the distinct paths of a host; urls are joined to their path once, at the end.
Statistics are aggregated before their shuffle and joined back with keys of many rows split, so one
host may hold any part of the rows. A node has at most ``max_branch`` literal children and one wildcard, so
a host has at most (max_branch + 1) ** (depth + 1) templates, whatever the number of its rows, and
the windows of the merging run over fewer. Each level is written to shared storage, small columns only. A
host without any labelled url gets one verdict for all its urls, that of the share among all labels.

Defined cases: a null url, or one without "://", has an empty host and path, and is judged as the
template of the empty host. Urls of any length are read as a whole. Of rules that are equally long the
first listed one counts; a share of exactly a half is rejected. Null page_ids and repeated rows are
kept. Columns other than page_id and url are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contraspark.llm.common import HOT_ROWS, attach, attach_stats, discard, materialise
from contraspark.llm.exact_dedup import normalised

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
MAX_BRANCH, DEPTH, ALPHA = 16, 4, 4.0
CHI_SQUARE = 3.841


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return normalised(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits (the first listed of equals); null without one."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest comes last, outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def merged(templates: DataFrame, levels: int) -> DataFrame:
    """Adds ``merged`` to templates (host, template, n, b): the template with "?" for its merged segments."""
    out = templates.withColumn("merged", F.col("template"))
    d = lambda c: F.sum(c).over(Window.partitionBy("host", "merged")).cast("double")
    for level in reversed(range(levels)):
        before, after = F.slice("merged", 1, level), F.slice("merged", level + 2, levels)
        out = out.withColumns({"_literal": F.coalesce(F.get("merged", F.lit(level)) != "*", F.lit(False)), "_before": before, "_after": after})
        node = Window.partitionBy("host", "_before", "_after", "_literal")
        out = out.withColumns({"_n": d("n"), "_b": d("b")}).withColumns({"_nn": F.sum("n").over(node).cast("double"), "_bb": F.sum("b").over(node).cast("double")})
        apart = F.col("_b") * F.col("_nn") - F.col("_bb") * F.col("_n")
        similar = apart * apart <= F.lit(CHI_SQUARE) * F.col("_n") * F.col("_bb") * (F.col("_nn") - F.col("_bb"))
        out = out.withColumn("merged", F.when(F.col("_literal") & similar, F.concat("_before", F.array(F.lit("?")), "_after")).otherwise(F.col("merged")))
    return out.select(*templates.columns, "merged")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_branch: int = MAX_BRANCH, depth: int = DEPTH, alpha: float = ALPHA) -> DataFrame:
    """page_id, host, path, rule, verdict, template (before and after the merging) and blocked_share (smoothed) of each row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", depth + 1)
    general = F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s))
    rows = materialise(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), general.alias("segments")), "urls")
    total = rows.agg(F.max(F.size("segments")), F.count("given"), F.count(F.when(F.col("given") == "block", 1))).first()

    # The tree is made of the distinct paths of a host, digits already generalised; rows are joined back once.
    labels, blocked = F.count("given"), F.count(F.when(F.col("given") == "block", 1))
    paths = rows.groupBy("host", "segments").agg(F.count("*").alias("urls"), labels.alias("n"), blocked.alias("b"))
    paths = materialise(paths.withColumn("template", F.array().cast("array<string>")), "paths")
    few = paths.count() <= HOT_ROWS  # then no key is hot, and nothing needs to be counted
    levels = total[0] or 0
    for level in range(levels):
        segment = F.get("segments", F.lit(level))
        children = paths.where(segment.isNotNull()).select("host", "template", segment.alias("segment")).distinct()
        crowded = children.groupBy("host", "template").agg(F.count("*").alias("children")).where(F.col("children") > max_branch)
        if not few:
            nodes = paths.groupBy("host", "template").agg(F.count("*").alias("paths"))
            crowded = materialise(crowded.join(nodes, ["host", "template"]), "crowded")
        known = attach(paths, crowded, ["host", "template"], F.col("segments"), how="left", rows=None if few else "paths")
        token = F.when(F.col("children").isNotNull(), "*").otherwise(segment)
        longer = F.when(segment.isNull(), F.col("template")).otherwise(F.concat("template", F.array(token)))
        old, paths = paths, materialise(known.select("host", "segments", "urls", "n", "b", longer.alias("template")), "paths")
        discard(old, *[] if few else [crowded])

    templates = paths.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("paths"))
    templates = materialise(merged(templates, levels), "templates")
    hosts = attach_stats(templates, ["host"], [F.sum("n").alias("hn"), F.sum("b").alias("hb")], F.col("template"), most=HOT_ROWS if few else None)
    d = lambda c: F.col(c).cast("double")
    own, path_of = Window.partitionBy("host", "merged"), lambda c: F.concat(F.lit("/"), F.array_join(c, "/"))
    prior = (total[2] + 1.0) / (total[1] + 2.0)
    at_host = (d("hb") + F.lit(alpha * prior)) / (d("hn") + F.lit(alpha))
    share = (F.sum("b").over(own).cast("double") + F.lit(alpha) * at_host) / (F.sum("n").over(own).cast("double") + F.lit(alpha))
    judged = hosts.select("host", "template", path_of("template").alias("own"), path_of("merged").alias("merged_template"), share.alias("blocked_share"), "paths")
    judged = attach(paths, judged if few else materialise(judged, "judged"), ["host", "template"], F.col("segments"), rows=None if few else "paths")
    judged = judged.select("host", "segments", F.col("own").alias("template"), "merged_template", "blocked_share", "urls")
    out = attach(rows, materialise(judged, "judged-paths"), ["host", "segments"], F.col("page_id"), rows="urls")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("blocked_share") >= 0.5, "block").otherwise("allow")).alias("verdict"), "template", "merged_template", "blocked_share",
    )


def verdict_sql(max_branch: int = MAX_BRANCH, depth: int = DEPTH, alpha: float = ALPHA) -> str:
    """The same verdicts for ``pages`` and ``RULES`` in DuckDB SQL."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    steps, last = [], "l0"
    for level in range(depth + 1):
        seg = f"segments[{level + 1}]"
        steps.append(f"""
c{level} AS (SELECT host, template FROM {last} WHERE {seg} IS NOT NULL GROUP BY host, template HAVING count(DISTINCT {seg}) > {max_branch}),
l{level + 1} AS (SELECT page_id, a.host, path, rule, given, segments,
  CASE WHEN {seg} IS NULL THEN a.template WHEN c.host IS NOT NULL THEN list_append(a.template, '*') ELSE list_append(a.template, {seg}) END AS template
  FROM {last} a LEFT JOIN c{level} c ON a.host = c.host AND a.template = c.template)""")
        last = f"l{level + 1}"
    merges, top = [], "a"
    for level in reversed(range(depth + 1)):
        merges.append(f"""
n{level} AS (SELECT host, template, n, b, merged, merged[1:{level}] AS before, merged[{level + 2}:] AS after, len(merged) > {level} AND merged[{level + 1}] <> '*' AS literal FROM {top}),
w{level} AS (SELECT *, sum(n) OVER own AS on1, sum(b) OVER own AS ob, sum(n) OVER node AS nn, sum(b) OVER node AS bb FROM n{level}
  WINDOW own AS (PARTITION BY host, merged), node AS (PARTITION BY host, before, after, literal)),
m{level} AS (SELECT host, template, n, b, CASE WHEN literal AND (ob * nn - bb * on1) * (ob * nn - bb * on1) <= {CHI_SQUARE}::DOUBLE * on1 * bb * (nn - bb)
  THEN list_concat(before, ['?'], after) ELSE merged END AS merged FROM w{level})""")
        top = f"m{level}"
    # All segments past the depth are one: as many pieces as a split with that limit gives.
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM rest),
fits AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS given FROM parsed, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
cut AS (SELECT page_id, host, path, rule, given, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM parsed LEFT JOIN fits USING (k)),
l0 AS (SELECT page_id, host, path, rule, given, []::VARCHAR[] AS template, list_transform(
  CASE WHEN len(parts) > {depth + 1} THEN list_append(parts[1:{depth}], array_to_string(parts[{depth + 1}:], '/')) ELSE parts END,
  lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS segments FROM cut),{",".join(steps)},
g AS (SELECT (count(*) FILTER (given = 'block') + 1.0::DOUBLE) / (count(given) + 2.0::DOUBLE) AS prior FROM l0),
a AS (SELECT host, template, template AS merged, count(given)::DOUBLE AS n, (count(*) FILTER (given = 'block'))::DOUBLE AS b FROM {last} GROUP BY host, template),{",".join(merges)},
h AS (SELECT host, template, sum(n) OVER own AS sn, sum(b) OVER own AS sb, sum(n) OVER (PARTITION BY host) AS hn, sum(b) OVER (PARTITION BY host) AS hb
  FROM {top} WINDOW own AS (PARTITION BY host, merged)),
j AS (SELECT host, template, (sb + {alpha}::DOUBLE * ((hb + {alpha}::DOUBLE * prior) / (hn + {alpha}::DOUBLE))) / (sn + {alpha}::DOUBLE) AS share FROM h, g)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM {last} JOIN j USING (host, template)"""
