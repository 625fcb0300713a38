"""Golden cases of normal forms, figures, comparisons and conformance."""

import difflib
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.config import MANDATED
from veriloom.functions import figures, similarity
from veriloom.functions import text as tx
from veriloom.operators import batch, evidence, geometry, matching, passage, review
from veriloom.sources import readers, sinks


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("given_, strict, loose", [
    ("  Old “Tom”\t® Gin ", 'Old "Tom" Gin', "old tom gin"), ("Rosé–Brut", "Rosé-Brut", "rose brut"), ("45.5% 40004. a.b", "45.5% 40004. a.b", "45.5% 40004. a b"),
    ("ALC. 14.5% BY VOL.", "ALC. 14.5% BY VOL.", "abv 14.5% abv"), ("1,000 mL", "1,000 mL", "1,000 ml"), ("a_b", "a_b", "a b"), ("ﬁne", "fine", "fine"), (None, "", ""), ("", "", ""),
])
def test_normal_forms(spark, given_, strict, loose):
    t = F.lit(given_).cast("string")
    assert one(spark, tx.normalize_strict(t)) == strict and one(spark, tx.normalize_loose(t)) == loose


@pytest.mark.parametrize("given_, repaired", [("75O", "750"), ("l0", "10"), ("OLD", "OLD"), ("Oil", "Oil"), ("L.75 L", "1.75 L"), ("LL", "LL")])
def test_digit_repair(given_, repaired):
    assert figures.repair_digits(given_) == repaired


@pytest.mark.parametrize("given_, abv, proof, from_proof", [
    ("45% Alc./Vol. (90 Proof)", 45, 90, False), ("90 PROOF", 45, 90, True), ("12,5%", 12.5, None, False), ("45", 45, None, False), ("4O%", 40, None, False), ("PROOF 102", 51, 102, True),
    ("100% agave 40% alc/vol", 40, None, False), ("60% malbec and 40% of other grapes of the valley; 13.5% alc. by vol.", 13.5, None, False),
])
def test_alcohol(given_, abv, proof, from_proof):
    v = figures.parse_alcohol(given_)
    assert (v["abv"], v["proof"], v["from_proof"]) == (abv, proof, from_proof)


def test_alcohol_shown_and_none():
    assert figures.parse_alcohol("ALC. 14.5% BY VOL. here")["text"] == "ALC. 14.5% BY VOL."
    assert figures.parse_alcohol("45% Alc./Vol. (90 Proof)")["text"] == "45% Alc./Vol. (90 Proof)"
    assert [figures.parse_alcohol(t) for t in (None, "", "no figure", "100% agave")] == [None] * 4
    assert figures.alcohol_statements("13.5% Petit Verdot") == [] and len(figures.alcohol_statements("40% ABV and 45% alc/vol")) == 2


@pytest.mark.parametrize("given_, ml", [
    ("750 mL", 750), ("750ml", 750), ("1.75 L", 1750), ("70 cl", 700), ("12 FL. OZ.", 354.88), ("12 FL OZ (355 mL)", 355), ("1 PINT 6 FL. OZ.", 650.62), ("1,000 mL", 1000), ("1,5 L", 1500), ("0,750 L", 750),
    ("ONE PINT", 473.18), ("HALF A GALLON", 1892.7), ("7S0 mL", 750), ("LL", None), ("LSL", None), ("CHICAGO IL 60607", None), ("0L", None), ("SOIL", None), (None, None),
])
def test_volume(given_, ml):
    v = figures.parse_volume(given_)
    assert (v and v["ml"]) == ml


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


@given(st.text("abc d", max_size=90), st.text("abc d", max_size=90))
@settings(max_examples=200, deadline=None)
def test_common_subsequence_against_the_table(a, b):
    assert similarity.common_subsequence(a, b) == subsequence(a, b)


def test_ratios(spark):
    assert similarity.indel_ratio("", "") == 100 and similarity.indel_ratio("a", "") == 0
    assert round(similarity.indel_ratio("bark brew", "barn brew")) == 89 and similarity.sorted_ratio("b a", "a b") == 100
    assert similarity.partial_ratio("abc", "xxabcyy") == 100 and similarity.partial_ratio("abcd", "cdxx") == pytest.approx(200 * 2 / 6)
    assert one(spark, similarity.ratio(F.lit(None).cast("string"), F.lit("a"))) is None
    assert one(spark, similarity.one_digit_apart(F.lit(1760), F.lit(1750))) is True and one(spark, similarity.one_digit_apart(F.lit(760), F.lit(1750))) is False


def text_result(spark, key, expected, found):
    df = spark.createDataFrame([(key, expected, found)], "key string, expected string, found string")
    df = df.withColumn("s", similarity.text_score(tx.normalize_loose("expected"), tx.normalize_loose("found")))
    return df.select(matching.compare_text(F.col("key"), F.col("expected"), F.col("found"), F.col("s")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("key, expected, found, kind, code", [
    ("brand_name", "OLD TOM", "OLD TOM.", "MATCH", "exact"), ("brand_name", "Old Tom", "OLD TOM", "NEAR MATCH", "case_differs"), ("class_type", "Old Tom", "OLD TOM", "MATCH", "loose"),
    ("class_type", "South Coast", "S O U T H C O A S T", "MATCH", "letter_spaced"), ("brand_name", "CON PAZ", "CON FAZ", "NEAR MATCH", "one_letter"), ("class_type", "Kentucky Straight Bourbon", "Kentucky Straight Burbon", "NEAR MATCH", "similar"),
    ("class_type", "Vodka", "Bourbon", "MISMATCH", "different"), ("class_type", "Vodka", None, "NOT FOUND", "not_found"),
])
def test_text_verdicts(spark, key, expected, found, kind, code):
    r = text_result(spark, key, expected, found)
    assert (r["verdict"], r["code"]) == (kind, code)


LABEL = ["OLD TOM DISTILLERY", "Kentucky Straight", "Bourbon Whiskey", "45% Alc./Vol. (90 Proof)", "750 mL"]


def test_locate_over_lines_and_downgrades(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(LABEL)], "label_id long, line_no int, text string")
    values = spark.createDataFrame([(1, "class_type", "Kentucky Straight Bourbon Whiskey", True), (1, "brand_name", "OLD TOM", True), (1, "bottler_name_address", "", False), (1, "x", "Tequila Blanco Reposado", True)], "label_id long, key string, expected string, required boolean")
    found = {r["key"]: r for r in matching.locate(values.select("label_id", "key", "expected"), lines).collect()}
    assert (found["class_type"]["line_start"], found["class_type"]["line_end"], found["class_type"]["score"]) == (1, 2, 100)
    assert found["brand_name"]["text"] == "OLD TOM" and found["brand_name"]["joined"] and "x" not in found
    results = {r["key"]: r["result"] for r in matching.compare_located(values, lines).collect()}
    assert results["class_type"]["verdict"] == "MATCH" and results["brand_name"]["code"] == "part_of_phrase"
    assert results["bottler_name_address"]["verdict"] == "SKIPPED" and results["x"]["verdict"] == "NOT FOUND"


def figure(spark, kind, expected, label):
    df = spark.createDataFrame([(expected, label)], "e string, l string")
    if kind == "alcohol":
        df = df.withColumns({"a": figures.alcohol_value("e"), "b": figures.alcohol_values("l"), "c": figures.alcohol_value("l")})
        return df.select(matching.compare_alcohol(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()[0]["r"]["code"]
    df = df.withColumns({"a": figures.volume_value("e"), "b": figures.volume_values("l")})
    return df.select(matching.compare_volume(F.col("a"), F.col("b")).alias("r")).collect()[0]["r"]["code"]


@pytest.mark.parametrize("kind, expected, label, code", [
    ("alcohol", "45% Alc./Vol. (90 Proof)", "45% alc/vol (90 proof)", "same"), ("alcohol", "45", "40% ABV", "differs"), ("alcohol", "45", "45% ABV or 40% ABV", "also_reads"), ("alcohol", "13.5%", "13.5% Petit Verdot", "unmarked"),
    ("alcohol", "13.5%", "12% Petit Verdot", "unmarked_other"), ("alcohol", "45", "nothing", "no_figure"), ("alcohol", "some", "45% ABV", "application_unreadable"), ("alcohol", "45% ABV", "45% ABV (100 proof)", "label_contradicts"),
    ("alcohol", "40% Alc./Vol. (82 Proof)", "40% alc/vol", "application_contradicts"), ("alcohol", "40% Alc./Vol. (80 Proof)", "40% alc/vol 90 proof", "proof_differs"),
    ("volume", "750 mL", "750 ML", "same"), ("volume", "750 mL", "25.4 FL OZ", "same"), ("volume", "750 mL", "812 mL", "differs"), ("volume", "1.5 L", "15L", "lost_point"), ("volume", "750 mL", "750 mL and 500 mL", "also_reads"),
    ("volume", "1750 mL", "1760 mL", "probable_misread"), ("volume", "750 mL", "760 mL", "ambiguous_misread"), ("volume", "750 mL", "none", "no_figure"), ("volume", "x", "750 mL", "application_unreadable"),
])
def test_figure_verdicts(spark, kind, expected, label, code):
    assert figure(spark, kind, expected, label) == code


@pytest.mark.parametrize("change, status", [
    (lambda t: t, "PASS"), (str.upper, "PASS"), (lambda t: t.replace("should not", "should"), "FAIL"), (lambda t: t.replace("alcoholic", "alcohalic", 1), "REVIEW"), (lambda t: t[: len(t) // 2], "FAIL"),
    (lambda t: t.split("(2)")[0] + t.split("(2)")[0] + "(2)" + t.split("(2)")[1], "FAIL"), (lambda t: t.replace("may cause", "may not cause"), "FAIL"),
])
def test_wording(spark, change, status):
    found = passage.check_wording(spark.createDataFrame([(change(MANDATED),)], "found_text string")).collect()[0]
    assert found["status"] == status


def test_word_differences_have_context(spark):
    a, b = "the quick brown fox jumps over".split(), "the quick red fox jumps".split()
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(similarity.word_diff("a", "b").alias("d")).collect()[0]["d"]
    plain = [op for op in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op[0] != "equal"]
    assert [(d["kind"], d["at"]) for d in df] == [(p[0], p[1]) for p in plain] and df[0]["expected_before"] == "the quick" and df[0]["found"] == "red"


def test_clarity_counts_unknown_as_clear(spark):
    rows = [(1, "brand_name", "MISMATCH", None), (2, "brand_name", "MISMATCH", False), (3, "brand_name", "MATCH", None), (4, "net_contents", "NOT FOUND", True)]
    fields = spark.createDataFrame(rows, "label_id long, key string, v string, clear boolean").withColumn("result", F.struct(F.col("v").alias("verdict"), F.lit("x").alias("code"), F.lit(0).alias("score"), F.lit("y").alias("found")))
    warnings = spark.createDataFrame([(i, "PASS", None) for i in (1, 2, 3, 4)], "label_id long, overall string, clear boolean")
    assert {r["label_id"]: r["overall"] for r in evidence.roll_up(fields, warnings).collect()} == {1: "FAIL", 2: "REVIEW", 3: "PASS", 4: "FAIL"}


def test_latest_answers_and_undo(spark):
    rows = [("j", "a", "k", "pass", 1), ("j", "a", "k", "fail", 2), ("j", "a", "m", "pass", 3), ("j", "a", "m", "clear", 4), ("j", "b", None, "skip", 5), ("j", "b", None, "pass", 6)]
    log = spark.createDataFrame(rows, "job string, application_id string, key string, decision string, seq long")
    found = {(r["application_id"], r["key"]): r["decision"] for r in review.latest_answers(log).collect()}
    assert found == {("a", "k"): "fail", ("b", ""): "pass"}


@pytest.mark.parametrize("answers, decision", [({}, ""), ({"a": "pass", "b": "fail"}, "fail"), ({"a": "pass", "b": "open"}, "partial"), ({"a": "pass"}, "pass"), ({"a": "pass", "b": "skip"}, "skip")])
def test_label_decision(spark, answers, decision):
    df = spark.createDataFrame([(answers,)], "a map<string,string>")
    assert df.select(review.label_decision(F.col("a")).alias("d")).collect()[0]["d"] == decision


def test_overlaps_are_found_across_grid_cells(spark):
    import random

    rng = random.Random(1)
    boxes = [(1, i, rng.randrange(900), rng.randrange(900), rng.randrange(1, 700), rng.randrange(1, 300)) for i in range(60)]
    df = spark.createDataFrame(boxes, "label_id long, line_no int, left int, top int, width int, height int")

    def share(a, b):
        x = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        y = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        return x * y / min(a[4] * a[5], b[4] * b[5])

    wanted = {(a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and share(a, b) >= 0.5}
    for cell in (64, 256):
        assert {(r["a"], r["b"]) for r in geometry.same_place_pairs(df, 0.5, cell).collect()} == wanted


def test_applications_csv(spark, tmp_path):
    path = tmp_path / "apps.csv"
    path.write_text('﻿Image;Brand;Class / Type;ABV;Net Contents\na.png;"Old ""Tom""\nGin";Gin;45%;750 mL\n;;;;\nb.png;X;Y;1%;1 L\n', encoding="utf-8")
    rows = readers.read_applications(spark, str(path)).orderBy("image").collect()
    assert [r["image"] for r in rows] == ["a.png", "b.png"] and rows[0]["brand_name"] == 'Old "Tom"\nGin' and rows[1]["net_contents"] == "1 L"


def test_log_isolates_malformed_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(json.dumps({"job": "j", "decision": "pass", "index": 1}) + "\n{broken\n\n" + json.dumps({"job": "k", "decision": "fail"}) + "\n")
    log = readers.read_log(spark, str(tmp_path / "log.jsonl")).cache()
    assert [r["job"] for r in readers.sound(log).orderBy("seq").collect()] == ["j", "k"] and readers.malformed(log).count() == 1


def test_images_and_archives(spark, tmp_path):
    (tmp_path / "A.PNG").write_bytes(b"one")
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("x/a.png", b"two")
        z.writestr("notes.txt", b"three")
    found = {r["path"].split("/")[-1]: r for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert {k: r["issue"] for k, r in found.items()} == {"A.PNG": None, "a.png": None, "bad.zip": "not a readable archive", "notes.txt": "not an image"}
    files = batch.collected_files(readers.read_images(spark, str(tmp_path)).where("issue is null"))
    assert [(r["name"], r["digest"]) for r in files.collect()] == [("a.png", None)]


def test_guarded_csv_and_answers_by_date(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("=1+1", 2), ("ok", -3)], "a string, b int"), str(tmp_path / "out"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "out")).toPandas()["a"]) == ["'=1+1", "ok"]
    sinks.append_answers(spark.sql("select timestamp '2024-01-02 03:04:05' ts, 'pass' decision"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).collect()[0]["decision"] == "pass"


def test_missing_headers_are_diagnosed(spark):
    headers = spark.createDataFrame([("Brnad Name",), ("Net",)], "header string")
    wanted = spark.createDataFrame([("brand_name", "brand name"), ("net_contents", "net"), ("image", "image")], "key string, alias string")
    assert {r["key"]: r["advice"] for r in batch.missing_headers(headers, wanted).collect()} == {"brand_name": "rename Brnad Name", "image": "add"}
