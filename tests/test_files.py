"""Draw files: header contract, one fault per row, import and stream import."""

import os

import pytest
from pyspark.sql import functions as F

from urnframe.operators import ingest
from urnframe.sources import csv, importing, sinks
from urnframe.streaming import jobs

# Lines of a draw file and one fault for each check.
HEADER = ",".join(csv.HEADER)
GOOD = '100,2024-01-05,"1,2,3,4,5,6",7,5000000.00,3'
FAULTS = {
    "bad_row_number": 'abc,2024-01-05,"1,2,3,4,5,6",7,,',
    "bad_draw_date": '101,2023-13-40,"1,2,3,4,5,6",7,,',
    "too_few_numbers": '102,2024-01-05,"1,2,3,4,5",7,,',
    "too_many_numbers": '103,2024-01-05,"1,2,3,4,5,6,7",7,,',
    "number_out_of_range": '104,2024-01-05,"1,2,3,4,5,46",7,,',
    "duplicate_in_draw": '105,2024-01-05,"1,2,3,4,5,5",7,,',
    "bad_super_number": '106,2024-01-05,"1,2,3,4,5,6",13,,',
    "bad_jackpot": '107,2024-01-05,"1,2,3,4,5,6",7,not-a-decimal,',
    "bad_winners": '108,2024-01-05,"1,2,3,4,5,6",7,,-5',
}


def write(folder, lines, name="draws.csv"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")
    return path


def read(spark, path):
    return csv.read_draw_csv(spark, path).withColumn("lottery_id", F.lit(1))


@pytest.mark.parametrize(
    "header, code",
    [
        ("draw_number;draw_date;numbers", "missing_columns"),
        (HEADER + ",bonus", "unknown_columns"),
        ("draw_date,draw_number,numbers,super_number,jackpot,winners", "unknown_columns"),
    ],
)
def test_header_is_refused(spark, tmp_path, header, code):
    path = write(tmp_path, [header, GOOD])
    with pytest.raises(csv.HeaderError) as caught:
        csv.read_draw_csv(spark, path)
    assert code in caught.value.codes


def test_empty_file_is_refused(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("")
    with pytest.raises(csv.HeaderError):
        csv.check_header(spark, str(path))


def test_one_code_per_fault(spark, tmp_path, rules_of):
    path = write(tmp_path, [HEADER, GOOD, *FAULTS.values()])
    rows = ingest.validate_rows(read(spark, path), rules_of())
    got = {r.row_number: [e.code for e in r.errors] for r in rows.collect()}
    want = {2: []} | {i + 3: [code] for i, code in enumerate(FAULTS)}
    assert got == want


def test_duplicates_and_counters(spark, tmp_path, rules_of):
    path = write(tmp_path, [HEADER, FAULTS["bad_winners"], GOOD, GOOD, GOOD.replace("100", "200")])
    validated = ingest.validate_rows(read(spark, path), rules_of())
    known = spark.createDataFrame([(1, 200)], "lottery_id int, draw_number bigint")
    status = ingest.classify_rows(validated, known)
    got = {r.row_number: r.status for r in status.collect()}
    assert got == {2: "error", 3: "imported", 4: "duplicate", 5: "duplicate"}
    counters = ingest.import_counters(status).first()
    assert (counters.total_rows, counters.imported_rows) == (4, 1)
    assert (counters.duplicate_rows, counters.error_rows, counters.last_processed_row) == (2, 1, 5)
    assert sinks.quarantine_errors(validated).count() == 1


def test_line_numbers_over_blocks(spark, tmp_path):
    lines = [HEADER] + [GOOD.replace("100", str(i), 1) for i in range(1, 2001)]
    path = write(tmp_path, lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = csv.read_draw_csv(spark, path).select("row_number", "draw_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2000
    assert all(r.row_number == int(r.draw_number) + 1 for r in rows)


def test_checksum_of_bytes(spark, tmp_path):
    import hashlib

    path = write(tmp_path, [HEADER, GOOD])
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert csv.file_checksum(spark, path).first().checksum == digest
    large = csv.file_checksum(spark, path, whole_up_to=1).collect()
    assert len(large) == 1 and large[0].checksum != digest


def test_checksum_has_one_definition_for_all_sizes(spark, tmp_path):
    import hashlib

    lines = [b"%d,\xff caf\xc3\xa9 %s" % (i, b"x" * (i % 37)) for i in range(400)]
    swapped = [*lines[:10], lines[11], lines[10], *lines[12:]]
    bodies = {
        "plain": b"\n".join(lines) + b"\n",
        "swapped": b"\n".join(swapped) + b"\n",
        "open": b"\r\n".join(lines),
        "mark": b"\xef\xbb\xbf" + b"\n".join(lines),
        "gaps": b"\n\n" + b"\n\n".join(lines) + b"\n\n",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_bytes(body)

    def want(body, size):
        leaves = [hashlib.sha256(body[i : i + size]).digest() for i in range(0, len(body), size)]
        return leaves[0].hex() if len(leaves) == 1 else hashlib.sha256(b"".join(leaves)).hexdigest()

    for split in ("700", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            for size in (1000, 1 << 30):
                got = {r[0].split("/")[-1][:-4]: r[1] for r in csv.file_checksum(spark, str(tmp_path), size).collect()}
                assert got == {n: want(b, size) for n, b in bodies.items()}
            files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path AS source_file", "length")
            got = {r[0].split("/")[-1][:-4]: r[1] for r in csv.range_checksum(spark, str(tmp_path), files, 1 << 30).collect()}
            assert got == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(set(got.values())) == len(bodies)


def test_snapshot_is_immutable(spark, tmp_path):
    df = spark.range(5)
    sinks.write_snapshot(df, str(tmp_path), "s", 1, ["id"])
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_snapshot(df, str(tmp_path), "s", 1, ["id"])


def test_stream_import_twice_adds_nothing(spark, tmp_path, rules_of):
    source = tmp_path / "in"
    write(source / "lottery_id=1", [HEADER, GOOD, GOOD, FAULTS["bad_jackpot"]], "a.csv")
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    args = (spark, str(source), root, checkpoint, rules_of())
    jobs.stream_import(*args)
    write(source / "lottery_id=1", [HEADER, GOOD, GOOD.replace("100", "300")], "b.csv")
    jobs.stream_import(*args)
    assert sorted(r.draw_number for r in importing.committed(spark, root).collect()) == [100, 300]
    assert [(r.error_code, r.line) for r in importing.committed(spark, root, "errors").collect()] == [("bad_jackpot", 4)]


def test_every_first_line_is_checked(spark, tmp_path):
    from urnframe.sources import csv

    good = ",".join(csv.HEADER)
    swapped = ",".join([*csv.HEADER[:-2], csv.HEADER[-1], csv.HEADER[-2]])
    for i, header in enumerate([good, "\ufeff" + good, good, good, swapped]):
        (tmp_path / f"f{i}.csv").write_text(header + "\n")
    with pytest.raises(csv.HeaderError):
        csv.check_header(spark, str(tmp_path))
    (tmp_path / "f4.csv").write_text("")
    with pytest.raises(csv.HeaderError):
        csv.check_header(spark, str(tmp_path))
    (tmp_path / "f4.csv").write_text(good + "\n")
    csv.check_header(spark, str(tmp_path))
