"""All licenses of a document are in the query's result, and variants of a text are told apart."""

import random

import numpy as np
import pytest

from contraspark.llm import license_scan, queries


def test_query_returns_every_license(spark, tmp_path):
    t = license_scan.TEMPLATES
    rows = [(1, t["MIT"].replace("sell copies", "sell many copies") + " filler " + t["MIT-line"]), (2, "no license here"), (3, t["ISC"] + " x " + t["GPL-3.0-line"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.licenses(spark, str(tmp_path)).collect()}
    assert [x["license"] for x in out[1]["licenses"]] == ["MIT", "MIT-line"] and out[1]["n_licenses"] == 2
    assert [x["license"] for x in out[3]["licenses"]] == ["ISC", "GPL-3.0-line"] and out[2]["licenses"] == []
    assert all(x["first_word"] < x["end_word"] for x in out[1]["licenses"])


def test_whole_texts_and_variants(spark):
    names = sorted(license_scan.TEMPLATES)
    df = spark.createDataFrame([(n, "start " + license_scan.TEMPLATES[n] + " end") for n in names], "doc_id string, text string")
    got = {r["doc_id"]: [(x["license"], x["coverage"], x["first_word"]) for x in r["licenses"]] for r in license_scan.license_scan(df).collect()}
    assert got == {n: [(n, 1.0, 1)] for n in names}


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_the_longest_where_words_are_unique():
    random.seed(11)
    for _ in range(200):
        a, b = (random.sample(range(20), random.randint(0, 20)) for _ in range(2))
        assert len(license_scan.align(a, b)) == longest_common(a, b)


def test_windows_are_those_of_a_count_from_scratch():
    random.seed(12)
    for _ in range(200):
        n = random.randint(0, 40)
        at, kind = sorted(random.sample(range(80), n)), [random.randrange(5) for _ in range(n)]
        counts, reach, need = [random.randint(0, 4) for _ in range(5)], random.randint(1, 30), random.randint(1, 9)
        want = []
        for lo in range(n):
            hi = next((k for k in range(lo, n) if at[k] >= at[lo] + reach), n)
            if sum(min(kind[lo:hi].count(k), counts[k]) for k in range(5)) >= need:
                want.append((lo, hi))
        assert list(license_scan.windows(at, kind, counts, reach, need)) == want


@pytest.mark.parametrize("noise", [0, 3, 9])
def test_edited_texts_are_found_with_the_coverage_of_brute_force(spark, noise):
    random.seed(13 + noise)
    rows, want = [], {}
    for i, name in enumerate(n for n in sorted(license_scan.TEMPLATES) if n.endswith(("text", "notice"))):
        words = license_scan.TEMPLATES[name].split()
        for _ in range(noise):
            words.insert(random.randrange(len(words)), f"foreign{random.randrange(99)}")
        for _ in range(noise // 3):
            del words[random.randrange(len(words))]
        rows.append((i, "before it " + " ".join(words) + " and after"))
        want[i] = name
    out = {r["doc_id"]: r["licenses"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    split = lambda t: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()]
    for i, name in want.items():
        best = max(out[i], key=lambda x: x["coverage"] * len(split(license_scan.TEMPLATES[x["license"]])))
        template = split(license_scan.TEMPLATES[name])
        brute = longest_common(split(rows[i][1]), template) / len(template)
        assert best["license"] == name and brute - 0.05 <= best["coverage"] <= brute + 1e-9
    assert np.isfinite(license_scan.LEAST_COVERAGE)


def test_ties_repeated_rows_and_an_interruption_longer_than_the_template(spark):
    line, other = license_scan.TEMPLATES["MIT-line"], "Licensed under the A license."
    templates = {"b": other, "a": other, "c": line}
    rows = [(1, other), (1, other), (None, f"x {line}"), (2, "Released under " + "filler " * 9 + "the MIT License.")]
    got = sorted((str(r["doc_id"]), [x["license"] for x in r["licenses"]]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, reach=4).collect())
    assert got == [("1", ["a"]), ("1", ["a"]), ("2", ["c"]), ("None", ["c"])]


@pytest.mark.parametrize("pieces", [2, 5])
def test_interruptions_of_any_length(spark, pieces):
    """Each template in pieces with thousands of foreign words, or another license, in between; half a license is none."""
    random.seed(17)
    t = license_scan.TEMPLATES
    names = [n for n in sorted(t) if len(t[n].split()) >= 8 * pieces]
    foreign = lambda n: " ".join(f"foreign{random.randrange(999)} the of and" for _ in range(n))
    rows, want = [], {}
    for i, name in enumerate(names):
        words = t[name].split()
        cuts = [len(words) * j // pieces for j in range(pieces + 1)]
        parts = [" ".join(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows.append((4 * i, foreign(9) + " " + f" {foreign(1500)} ".join(parts) + " " + foreign(2000)))
        want[4 * i] = [name]
        inner = "MPL-2.0-notice"  # it shares no runs with the others
        if inner != name:
            rows.append((4 * i + 1, parts[0] + f" {foreign(900)} {t[inner]} {foreign(900)} " + " ".join(parts[1:])))
            want[4 * i + 1] = sorted([name, inner])
        rows.append((4 * i + 2, f" {foreign(1500)} ".join(reversed(parts)) if pieces == 5 else parts[0] + " " + foreign(1500)))
    out = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert names and {i: sorted(out[i]) for i in want} == want
    assert all(names[i // 4] not in found for i, found in out.items() if i % 4 == 2)
