"""Streams that are stopped and started again, files in several encodings, and places of lines however files are split."""

import json

from pyspark.sql import functions as F

from veriloom.sources import readers
from veriloom.streaming import answers, tables

ANSWERS = "job string, application_id string, key string, decision string, seq long, ts timestamp"


def put(spark, folder, name, rows):
    spark.createDataFrame([(*r, None) for r in rows], ANSWERS).withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_standing_answers_survive_late_and_repeated_records_and_a_restart(spark, tmp_path):
    source, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")
    put(spark, source, "a", [("j", "1", "brand", "pass", 5), ("j", "2", None, "fail", 6), ("j", "3", "brand", "pass", 7), (None, "4", "x", "skip", 1)])
    put(spark, source, "b", [("j", "1", "brand", "fail", 4), ("j", "2", None, "fail", 6), ("j", "3", "brand", "clear", 8)])
    first = answers.standing_answers(stream(spark, source), table, progress)
    assert sorted((str(r.application_id), r.key, r.decision) for r in first.collect()) == [("1", "brand", "pass"), ("2", "", "fail"), ("3", "brand", None), ("4", "x", "skip")]
    put(spark, source, "c", [("j", "1", "brand", "fail", 9), ("j", "3", "brand", "skip", 3), ("k", "1", "brand", "pass", 1)])
    again = answers.standing_answers(stream(spark, source), table, progress)
    found = sorted((str(r.job), r.application_id, r.key, r.decision, r.seq) for r in again.collect())
    assert found == [("None", "4", "x", "skip", 1), ("j", "1", "brand", "fail", 9), ("j", "2", "", "fail", 6), ("j", "3", "brand", None, 8), ("k", "1", "brand", "pass", 1)]
    whole = tables.last_rows(answers.answers_to_keep(spark.read.schema(ANSWERS).option("recursiveFileLookup", True).parquet(str(source))), ["job", "application_id", "key"], ["seq"])
    assert sorted(map(str, (tuple(r) for r in whole.withColumn("decision", F.nullif("decision", F.lit("clear"))).select(*again.columns).collect()))) == sorted(map(str, (tuple(r) for r in again.collect())))


def test_a_base_takes_in_the_batches_before_it(spark, tmp_path):
    source, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")
    for i in range(5):
        put(spark, source, f"f{i}", [("j", str(i % 2), "k", f"d{i}", i)])
    keep = answers.answers_to_keep(stream(spark, source))
    rows = tables.run_upsert(keep, table, progress, ["job", "application_id", "key"], ["seq"], compacted=2)
    assert sorted((r.application_id, r.decision) for r in rows.collect()) == [("0", "d4"), ("1", "d3")]
    assert sorted(r[0] for r in spark.read.parquet(f"{table}/bases").select("_at").distinct().collect())[-1] == 3
    assert tables.run_upsert(keep, table, progress, ["job", "application_id", "key"], ["seq"], compacted=2).count() == 2  # nothing new


def test_documents_are_scored_as_they_come(spark, tmp_path):
    schema = "label_id long, seq long, words array<struct<text:string,conf:double,sideways:boolean>>"
    word = lambda t, c, s=False: (t, float(c), s)
    rows = [(1, 0, [word("gin", 90), word("of", 90), word("ale", 50, True)]), (2, 0, []), (3, 0, None), (1, 1, [word("rum", 100)])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = answers.scored_documents(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "p")).collect()
    assert [(r.label_id, r.seq, r.words, r.clear_words, r.clear_share, r.mean_conf, r.low_share, r.sideways) for r in found] == [(1, 1, 1, 1, 1.0, 100.0, 0.0, 0)]


def test_each_file_has_its_own_encoding_separator_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Application ID,Brand,Net Contents\r\n1,\"Café, \"\"No 1\"\"\nTwo\",750 mL\r\n\r\n2,x\r\n".encode())
    (tmp_path / "b.CSV").write_bytes("brand name;ABV;id;brand\nChâteau;12,5%;7;other\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("ID\tVOLUME\tcolour\n9\t1 L\tred\textra\n".encode())
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(b"id\n5\n")
    rows = {r.application_id: r for r in readers.read_application_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1", "2", "7", "9"}
    assert (rows["1"].brand_name, rows["1"].net_contents, rows["1"].record) == ('Café, "No 1"\nTwo', "750 mL", 1)
    assert (rows["2"].brand_name, rows["2"].net_contents, rows["2"].record) == ("x", "", 3)
    assert (rows["7"].brand_name, rows["7"].alcohol_content) == ("Château", "12,5%") and (rows["9"].net_contents, rows["9"].brand_name) == ("1 L", "")


def test_lines_keep_their_place_however_files_are_split(spark, tmp_path):
    for name, n in (("a.jsonl", 400), ("b.jsonl", 3)):
        text = [json.dumps({"job": f"{name}{i}", "decision": "pass"}) if i % 7 else ("" if i % 2 else "{broken") for i in range(n)]
        (tmp_path / name).write_text("\n".join(text))
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k", "300"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            log = readers.read_log(spark, str(tmp_path))
            good = sorted((r.seq, r.file[-7:], r.line, r.job) for r in readers.sound(log).collect())
            bad = sorted((r.seq, r.file[-7:], r.line, r._corrupt) for r in readers.malformed(log).collect())
            found.append((good, bad))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2]
    good, bad = found[0]
    assert [j for *_, j in good] == [f"a.jsonl{i}" for i in range(400) if i % 7] + [f"b.jsonl{i}" for i in range(3) if i % 7]
    assert all(j == f"{f}{line - 1}" for _, f, line, j in good) and [(f, line, c) for _, f, line, c in bad][:2] == [("a.jsonl", 1, "{broken"), ("a.jsonl", 15, "{broken")]
