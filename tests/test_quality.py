"""Data-quality faults: keys that fit no column, digests of awkward cells, files of broken bytes."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from urnframe.functions.columns import row_digest
from urnframe.operators import identity, ingest
from urnframe.sources import csv

HEADER = ",".join(csv.HEADER)


@pytest.fixture
def raw(spark):
    cells = [
        ("9" * 25, "2024-01-05", "1,2,3,4,5,6", "7", "5", "3"),
        ("9" * 25, "2024-01-05", "1,2,3,4,5,6", "7", "5", "3"),
        (str(2**63 - 1), "2024-01-05", "1,2,3,4,5,6", "7", "1e5", "3"),
        ("11", "2024-01-05", "1,2,3,4,5,6", "7", "NaN", "3"),
        ("12", "2024-01-05", "1,2,3,4,5,6", "7", "1e40", "3"),
        ("13", "2024-01-05", "1,2,3,4,5,6", "7", "inf", "9" * 30),
        ("14", "2024-01-05", "1,2,3,4,5," + "9" * 30, "9" * 30, "", ""),
        ("15", "2024-01-05", "1,2,3,4,5,6", "", ".5", ""),
    ]
    return spark.createDataFrame([(1, i, *c) for i, c in enumerate(cells)], "lottery_id int, row_number bigint, " + ", ".join(f"{c} string" for c in csv.HEADER))


def test_values_that_fit_no_column_are_errors(raw, rules_of):
    validated = ingest.validate_rows(raw, rules_of())
    got = {r.row_number: [e.code for e in r.errors] for r in validated.collect()}
    assert got == {
        0: ["bad_row_number"], 1: ["bad_row_number"], 2: [], 3: ["bad_jackpot"], 4: ["bad_jackpot"],
        5: ["bad_jackpot", "bad_winners"], 6: ["number_out_of_range", "bad_super_number"], 7: [],
    }
    valid = ingest.normalize_rows(validated.where(F.size("errors") == 0)).collect()
    assert all(None not in (r.draw_number, r.draw_date) and None not in r.numbers for r in valid)


def test_rows_without_a_key_are_never_imported(raw, spark, rules_of):
    nothing = spark.createDataFrame([], "lottery_id int, draw_number bigint")
    unchecked = ingest.validate_rows(raw, rules_of(), ["bad_draw_date"])
    status = {r.row_number: r.status for r in ingest.classify_rows(unchecked, nothing).collect()}
    assert [status[i] for i in range(3)] == ["error", "error", "imported"]
    fresh = ingest.append_new_draws(ingest.normalize_rows(raw), nothing).collect()
    assert sorted(r.draw_number for r in fresh) == [11, 12, 13, 14, 15, 2**63 - 1]


def test_digests_tell_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "~"), ("a", ""), ("", "a"), ("a", "-"), ("s1:a", ""), ("1", "1s1:1"), ("é", "e")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(row_digest(F.col("x"), F.col("y"))).distinct().count() == len(rows)
    one = spark.createDataFrame([(1, "1", True, "true", 1.0)], "i int, s string, b boolean, t string, d double")
    digests = one.select(*[row_digest(F.col(c)).alias(c) for c in one.columns]).first()
    assert len(set(digests)) == 5
    assert one.select(row_digest(F.col("i")) == row_digest(F.col("i").cast("bigint"))).first()[0]


def test_digests_do_not_see_the_scale(spark):
    cells = [Decimal("1.5"), Decimal("-0.25"), Decimal("100"), Decimal("0"), None]
    rows = [(i, c, c) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "id int, narrow decimal(10,2), wide decimal(20,8)")
    assert df.where(row_digest(F.col("narrow")) != row_digest(F.col("wide"))).count() == 0
    assert df.select(row_digest(F.col("wide"))).distinct().count() == len(cells)
    prints = identity.table_fingerprint(df, ["id", "narrow"]).first(), identity.table_fingerprint(df, ["id", "wide"]).first()
    assert prints[0] == prints[1]


def test_one_bad_byte_refuses_the_file(spark, tmp_path):
    line = '{},2024-01-05,"1,2,3,4,5,6",7,,'
    good = "\n".join([HEADER, *(line.format(i) for i in range(50))]) + "\n"
    (tmp_path / "good.csv").write_text(good)
    (tmp_path / "also.csv").write_text(good.replace("2024", "2023") + line.format("é�") + "\n", encoding="utf-8")
    (tmp_path / "bad.csv").write_bytes(good.encode().replace(b"7,,", b"7,\xc3,", 1))
    assert [r.source_file.rsplit("/", 1)[1] for r in csv.undecodable_files(spark, str(tmp_path)).collect()] == ["bad.csv"]
    rows = csv.read_draw_csv(spark, str(tmp_path))
    files = {r[0].rsplit("/", 1)[1]: r["count"] for r in rows.groupBy("source_file").count().collect()}
    assert files == {"good.csv": 50, "also.csv": 51}
