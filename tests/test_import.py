"""Committed imports: refused files, provenance, resume after a broken run; streaming state."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from urnframe.sources import csv, importing
from urnframe.streaming import jobs

HEADER = ",".join(csv.HEADER)


def line(number, numbers="1,2,3,4,5,6", rest="7,,"):
    return f'{number},2024-01-05,"{numbers}",{rest}'


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in" / "lottery_id=1"
    other = tmp_path / "in" / "lottery_id=2"
    os.makedirs(folder), os.makedirs(other)
    swapped = ",".join([*csv.HEADER[:-2], csv.HEADER[-1], csv.HEADER[-2]])
    files = {
        "a.csv": [HEADER, line(1), line(2), "", line("x"), line(1)],
        "b.csv": ["﻿" + HEADER, line(2), line(3), line(70_000)],
        "c.csv": [swapped, line(8)],
        "d.csv": [HEADER.replace("winners", "bonus"), line(9)],
        "e.csv": [HEADER, line(5)],
    }
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    (folder / "f.csv").write_bytes((HEADER + "\n" + line(10) + "\n").encode() + b"\xff\n")
    (folder / "g.csv").write_text("")
    (other / "a.csv").write_text("\n".join([HEADER, line(1)]) + "\n")
    return str(tmp_path / "in")


@pytest.fixture
def rules(rules_of):
    return rules_of().unionByName(rules_of().withColumn("lottery_id", F.lit(2)))


def state(spark, root):
    name = lambda r: "/".join(r.source_file.split("/")[-2:])
    draws = sorted((r.lottery_id, r.draw_number, name(r), r.line) for r in importing.committed(spark, root).collect())
    errors = sorted((name(r), r.line, r.error_code) for r in importing.committed(spark, root, "errors").collect())
    refused = {name(r): r.code for r in importing.committed(spark, root, "refused").collect()}
    commits = {
        name(r): (r.last_line, r.total_rows, r.imported_rows, r.duplicate_rows, r.error_rows, r.refused)
        for r in importing.committed(spark, root, "commits").collect()
    }
    return draws, errors, refused, commits


ONE = "lottery_id=1/"
DRAWS = [
    (1, 1, ONE + "a.csv", 2), (1, 2, ONE + "a.csv", 3), (1, 3, ONE + "b.csv", 3), (1, 5, ONE + "e.csv", 2),
    (1, 70_000, ONE + "b.csv", 4), (2, 1, "lottery_id=2/a.csv", 2),
]
REFUSED = {ONE + "c.csv": "unknown_columns", ONE + "d.csv": "missing_columns", ONE + "f.csv": "bad_encoding"}


@pytest.mark.parametrize("size", [100, 2])
def test_import_and_resume(spark, source, rules, tmp_path, size):
    root = str(tmp_path / "out")
    importing.import_files(spark, source, root, rules, size)
    draws, errors, refused, commits = done = state(spark, root)
    assert draws == DRAWS and errors == [(ONE + "a.csv", 5, "bad_row_number")]
    assert refused == {**REFUSED, ONE + "g.csv": "empty_file"}
    assert commits[ONE + "a.csv"] == (6, 4, 2, 1, 1, False) and commits[ONE + "b.csv"] == (4, 3, 2, 1, 0, False)
    assert commits[ONE + "c.csv"] == (2, 0, 0, 0, 0, True) and commits[ONE + "g.csv"] == (0, 0, 0, 0, 0, True)
    assert importing.import_files(spark, source, root, rules, size) == 0
    # a run that broke off before its last commit: its folders do not count, and are written again
    last = max(int(d.split("=")[1]) for d in os.listdir(f"{root}/commits") if "=" in d)
    shutil.rmtree(f"{root}/commits/batch={last}")
    assert state(spark, root) != done
    assert importing.import_files(spark, source, root, rules, size) == 1
    assert state(spark, root) == done


def test_stream_and_batch_agree(spark, source, rules, tmp_path):
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    jobs.stream_import(spark, source, root, checkpoint, rules, 3)
    draws, errors, refused, commits = state(spark, root)
    assert [(i, n) for i, n, _, _ in draws] == [(i, n) for i, n, _, _ in DRAWS] and refused == REFUSED
    assert errors == [(ONE + "a.csv", 5, "bad_row_number")]
    assert sum(c[1] for c in commits.values()) == 9


def _stream(spark, tmp_path, schema, name):
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def test_gap_state_with_late_rows(spark, tmp_path):
    schema = "lottery_id int, number int, draw_number bigint"
    root, checkpoint = str(tmp_path / "gaps"), str(tmp_path / "checkpoint")
    for rows in ([10, 20], [15], [100_000, 20], [70_000, 5]):
        frame = spark.createDataFrame([(1, 7, d) for d in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_to_end(_stream(spark, tmp_path, schema, "in").writeStream.foreachBatch(jobs.gap_batches(root)), checkpoint)
        if rows == [15]:
            assert [tuple(r) for r in jobs.gap_state(spark, root).collect()] == [(1, 7, 20, 2, 5, 5, 10)]
    assert [tuple(r) for r in jobs.gap_state(spark, root).collect()] == [(1, 7, 100_000, 5, 5, 69_980, 99_995)]


def test_sessions_over_a_restart_and_late_rows(spark, tmp_path):
    schema = "kind string, ts timestamp, item int"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    arrivals = [
        [("a", "10:00", 1), ("a", "10:06", 2)],
        [("a", "10:12", 3), ("b", "10:13", 9), ("a", "12:30", 4)],  # goes on with the open session
        [("a", "10:20", 5), ("a", "14:30", 6)],  # 10:20 is behind the watermark
    ]
    for rows in arrivals:
        frame = spark.createDataFrame([(k, t, i) for k, t, i in rows], "kind string, t string, item int")
        frame = frame.select("kind", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("ts"), "item")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = _stream(spark, tmp_path, schema, "in").withWatermark("ts", "1 hour")
        windows = jobs.windowed_draws(stream, "ts", "kind", "item", F.session_window("ts", "10 minutes"))
        jobs.run_to_end(windows.writeStream.outputMode("append").foreachBatch(jobs.batches_to(out)), checkpoint)
    got = sorted((r.kind, f"{r.start:%H:%M}", f"{r.end:%H:%M}", r["items"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", "10:00", "10:22", [1, 2, 3]), ("a", "12:30", "12:40", [4]), ("b", "10:13", "10:23", [9])]


def test_dedupe_forgets_behind_the_watermark(spark, tmp_path):
    schema = "kind string, ts timestamp"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for times in (["10:00"], ["10:20"], ["13:00"], ["13:10"]):  # 13:00 moves the watermark over 10:00 + 1 hour
        frame = spark.createDataFrame([("a", t) for t in times], "kind string, t string")
        frame = frame.select("kind", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("ts"))
        frame = frame.unionByName(frame.withColumn("kind", F.lit("clock"))) if times == ["13:00"] else frame
        frame.where("kind <> 'a' or ts <> timestamp '2024-01-01 13:00:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_dedupe(_stream(spark, tmp_path, schema, "in"), ["kind"], "ts", "1 hour")
        jobs.run_to_end(stream.writeStream.outputMode("append").foreachBatch(jobs.batches_to(out)), checkpoint)
    got = sorted((r.kind, f"{r.ts:%H:%M}") for r in spark.read.parquet(out).collect())
    assert got == [("a", "10:00"), ("a", "13:10"), ("clock", "13:00")]
