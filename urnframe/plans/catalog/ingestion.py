"""Catalog: files, validation, import, datasets, identity and version life cycle."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import rounded, row_digest
from urnframe.operators import datasets, identity, ingest, stats
from urnframe.plans.catalog.statistics import FREQ, GAPS
from urnframe.plans.registry import job
from urnframe.session import shared_dir
from urnframe.sources import csv, sinks

CELLS = ", ".join(csv.HEADER)

CHECKED = """
cells AS (
  SELECT *, list_filter(list_transform(string_split(numbers, ','), lambda x: trim(x)), lambda x: x <> '') AS toks
  FROM raw_draws),
parsed AS (
  SELECT *, list_transform(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]+')),
                           lambda x: cast(x AS bigint)) AS vals FROM cells),
found AS (
  SELECT lottery_id, row_number, 1 AS ord, 'bad_row_number' AS code, 1 AS n FROM parsed
  WHERE NOT regexp_full_match(trim(draw_number), '[0-9]*[1-9][0-9]*') OR try_cast(trim(draw_number) AS bigint) IS NULL
  UNION ALL
  SELECT lottery_id, row_number, 2, 'bad_draw_date', 1 FROM parsed
  WHERE NOT regexp_full_match(trim(draw_date), '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(trim(draw_date) AS date) IS NULL
  UNION ALL
  SELECT lottery_id, row_number, 3, 'number_out_of_range',
         len(toks) - len(list_filter(vals, lambda v: v BETWEEN 1 AND 45)) FROM parsed
  WHERE len(toks) > len(list_filter(vals, lambda v: v BETWEEN 1 AND 45))
  UNION ALL SELECT lottery_id, row_number, 4, 'too_few_numbers', 1 FROM parsed WHERE len(vals) < 4
  UNION ALL SELECT lottery_id, row_number, 4, 'too_many_numbers', 1 FROM parsed WHERE len(vals) > 4
  UNION ALL SELECT lottery_id, row_number, 5, 'duplicate_in_draw', 1 FROM parsed
  WHERE len(list_distinct(vals)) < len(vals)
  UNION ALL SELECT lottery_id, row_number, 6, 'bad_super_number', 1 FROM parsed
  WHERE trim(super_number) <> '' AND coalesce(try_cast(super_number AS int), 0) NOT BETWEEN 1 AND 16
  UNION ALL SELECT lottery_id, row_number, 7, 'bad_jackpot', 1 FROM parsed
  WHERE trim(jackpot) <> '' AND try_cast(trim(jackpot) AS decimal(18,2)) IS NULL
  UNION ALL SELECT lottery_id, row_number, 8, 'bad_winners', 1 FROM parsed
  WHERE trim(winners) <> '' AND (NOT regexp_full_match(trim(winners), '[0-9]+') OR try_cast(trim(winners) AS bigint) IS NULL)),
valid AS (
  SELECT lottery_id, row_number, cast(trim(draw_number) AS bigint) AS draw_number FROM raw_draws r
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.lottery_id = r.lottery_id AND f.row_number = r.row_number)),
existing AS (SELECT lottery_id, draw_number FROM draws WHERE draw_date < date '1996-01-01'),
classified AS (
  SELECT r.lottery_id, r.row_number, v.draw_number,
         CASE WHEN v.draw_number IS NULL THEN 'error'
              WHEN e.draw_number IS NOT NULL
                OR row_number() OVER (PARTITION BY r.lottery_id, v.draw_number ORDER BY r.row_number) > 1
              THEN 'duplicate' ELSE 'imported' END AS status
  FROM raw_draws r LEFT JOIN valid v ON v.lottery_id = r.lottery_id AND v.row_number = r.row_number
  LEFT JOIN existing e ON e.lottery_id = v.lottery_id AND e.draw_number = v.draw_number)"""


def scratch(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def existing(t):
    return t.draws.where("draw_date < date '1996-01-01'").select("lottery_id", "draw_number")


@job("read_draw_csv", f"SELECT lottery_id, {CELLS} FROM raw_draws")
def _(t):
    path = scratch(t, "draw_csv")
    rows = t.raw_draws.select("lottery_id", *csv.HEADER)
    (
        rows.write.partitionBy("lottery_id")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return csv.read_draw_csv(t.spark, path).select("lottery_id", *csv.HEADER)


@job("check_header", "SELECT count(*) AS files_with_rows, 0 AS bad_header FROM (SELECT DISTINCT lottery_id FROM raw_draws)")
def _(t):
    path = scratch(t, "header_csv")
    rows = t.raw_draws.select("lottery_id", *csv.HEADER)
    rows.write.partitionBy("lottery_id").option("header", True).csv(path)
    csv.check_header(t.spark, path)
    read = csv.read_draw_csv(t.spark, path, check=False)
    return read.agg(
        F.count_distinct("lottery_id").alias("files_with_rows"),
        F.count_if(F.col("draw_number") == "draw_number").alias("bad_header"),
    )


@job("file_checksum")
def _(t):
    path = scratch(t, "checksum_csv")
    rows = t.raw_draws.select("lottery_id", *csv.HEADER)
    rows.write.partitionBy("lottery_id").option("header", True).csv(path)
    return csv.file_checksum(t.spark, f"{path}/*/*.csv")


@job("write_snapshot", f"{FREQ} SELECT * FROM freq")
def _(t):
    root = scratch(t, "snapshots")
    sinks.write_snapshot(
        stats.frequency(t.numbers), root, "frequency", 1, ["lottery_id", "number"]
    )
    return sinks.read_snapshot(t.spark, root, "frequency", 1)


@job(
    "export_csv",
    f"""{FREQ} SELECT concat('lottery-', lottery_id) AS run_label, 'statistics' AS engine_type,
           concat('number-', number) AS model_id, 'count' AS metric_name, cast(n AS varchar) AS value FROM freq""",
)
def _(t):
    path = scratch(t, "export_csv")
    runs = stats.frequency(t.numbers).select(
        F.concat(F.lit("lottery-"), "lottery_id").alias("run_label"),
        F.lit("statistics").alias("engine_type"),
        F.concat(F.lit("number-"), "number").alias("model_id"),
        F.lit("count").alias("metric_name"),
        F.col("n").alias("value"),
    )
    sinks.export_csv(runs, path)
    schema = ", ".join(f"{c} string" for c in sinks.RUN_COLUMNS)
    return t.spark.read.option("header", True).schema(schema).csv(path)


@job(
    "export_json",
    f"""{FREQ} SELECT '{{"lottery_id":' || lottery_id || ',"number":' || number || ',"n":' || n || '}}' AS value
        FROM freq""",
)
def _(t):
    path = scratch(t, "export_json")
    sinks.export_json(stats.frequency(t.numbers), path, ["lottery_id", "number", "n"])
    return t.spark.read.text(path)


@job(
    "json_payload",
    """SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS bigint)) AS k_sum,
              min(try_cast(json_extract_string(props, '$.k') AS bigint)) AS k_min FROM events GROUP BY 1""",
)
def _(t):
    payload = t.raw("events").select(
        "event_type", F.from_json("props", "map<string,bigint>").alias("metrics")
    )
    k = F.col("metrics")["k"]
    return payload.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.min(k).alias("k_min")
    )


@job(
    "quarantine_errors",
    f"""{CHECKED} SELECT f.lottery_id, f.row_number, f.code AS error_code,
          row_number() OVER (PARTITION BY f.lottery_id, f.row_number ORDER BY f.ord, u.i) AS error_no,
          concat_ws(',', r.draw_number, r.draw_date, r.numbers, r.super_number, r.jackpot, r.winners) AS raw_row
        FROM found f JOIN raw_draws r ON r.lottery_id = f.lottery_id AND r.row_number = f.row_number,
        LATERAL (SELECT unnest(range(f.n)) AS i) u""",
)
def _(t):
    rows = sinks.quarantine_errors(ingest.validate_rows(t.raw_draws, t.lottery))
    return rows.select("lottery_id", "row_number", "error_code", "error_no", "raw_row")


@job(
    "normalize_rows",
    """cells AS (
      SELECT *, list_filter(list_transform(string_split(numbers, ','), lambda x: trim(x)), lambda x: x <> '') AS toks
      FROM raw_draws)
    SELECT lottery_id, row_number, try_cast(trim(draw_number) AS bigint) AS draw_number,
           CASE WHEN regexp_full_match(trim(draw_date), '[0-9]{4}-[0-9]{2}-[0-9]{2}')
                THEN try_cast(trim(draw_date) AS date) END AS draw_date,
           array_to_string(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]+')), ',') AS numbers,
           try_cast(trim(super_number) AS int) AS super_number,
           try_cast(trim(jackpot) AS decimal(18,2)) AS jackpot, try_cast(trim(winners) AS bigint) AS winners
    FROM cells""",
)
def _(t):
    out = ingest.normalize_rows(t.raw_draws)
    return out.withColumn("numbers", F.array_join(F.col("numbers").cast("array<string>"), ","))


def _check_job(name: str, check: str, code: str) -> None:
    @job(name, f"{CHECKED} SELECT lottery_id, row_number, code, cast(n AS bigint) AS n FROM found WHERE code = '{code}'")
    def _(t):
        return ingest.rows_with(t.raw_draws, t.lottery, check).where(F.col("code") == code)


for _name, _check in {
    "bad_row_number": "bad_row_number",
    "bad_draw_date": "bad_draw_date",
    "number_out_of_range": "number_out_of_range",
    "too_few_numbers": "wrong_count",
    "too_many_numbers": "wrong_count",
    "duplicate_in_draw": "duplicate_in_draw",
    "bad_super_number": "bad_super_number",
    "bad_jackpot": "bad_jackpot",
    "bad_winners": "bad_winners",
}.items():
    _check_job(_name, _check, _name)


@job(
    "validate_rows",
    f"""{CHECKED} SELECT r.lottery_id, r.row_number, coalesce(e.codes, '') AS codes FROM raw_draws r
        LEFT JOIN (SELECT f.lottery_id, f.row_number, string_agg(f.code, ',' ORDER BY f.ord) AS codes
                   FROM found f, LATERAL (SELECT unnest(range(f.n)) AS i) u GROUP BY 1, 2) e
        ON e.lottery_id = r.lottery_id AND e.row_number = r.row_number""",
)
def _(t):
    out = ingest.validate_rows(t.raw_draws, t.lottery)
    return out.select("lottery_id", "row_number", F.array_join("errors.code", ",").alias("codes"))


@job("classify_rows", f"{CHECKED} SELECT * FROM classified")
def _(t):
    return ingest.classify_rows(ingest.validate_rows(t.raw_draws, t.lottery), existing(t))


@job(
    "import_counters",
    f"""{CHECKED} SELECT lottery_id, count(*) AS total_rows, count(*) FILTER (status = 'imported') AS imported_rows,
          0 AS skipped_rows, count(*) FILTER (status = 'duplicate') AS duplicate_rows,
          count(*) FILTER (status = 'error') AS error_rows, max(row_number) AS last_processed_row
        FROM classified GROUP BY 1""",
)
def _(t):
    validated = ingest.validate_rows(t.raw_draws, t.lottery)
    return ingest.import_counters(ingest.classify_rows(validated, existing(t)))


RUNS = """
runs AS (
  SELECT lottery_id, lottery_id * 10 + k AS run_id, status, 'v1' AS engine, last_row * k // 4 AS last_processed_row
  FROM (SELECT lottery_id, max(row_number) AS last_row FROM raw_draws GROUP BY 1),
       (VALUES (1, 'partial'), (2, 'partial'), (3, 'completed')) s(k, status))"""


@job(
    "resume_import",
    f"""{RUNS} SELECT r.lottery_id, r.row_number FROM raw_draws r
        JOIN runs u ON u.lottery_id = r.lottery_id AND u.run_id % 10 = 2
        WHERE r.row_number > u.last_processed_row""",
)
def _(t):
    steps = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.lit(s).alias("status"))
                for k, s in ((1, "partial"), (2, "partial"), (3, "completed"))
            ]
        )
    )
    last = t.raw_draws.groupBy("lottery_id").agg(F.max("row_number").alias("last_row"))
    runs = last.withColumn("s", steps).select(
        "lottery_id",
        (F.col("lottery_id") * 10 + F.col("s.k")).alias("run_id"),
        "s.status",
        F.lit("v1").alias("engine"),
        F.expr("last_row * s.k div 4").alias("last_processed_row"),
    )
    out = ingest.resume_import(t.raw_draws, runs, {"engine": "v1"})
    return out.select("lottery_id", "row_number")


@job(
    "append_new_draws",
    f"""{CHECKED} SELECT c.lottery_id, c.draw_number, c.row_number, cast(r.draw_date AS date) AS draw_date
        FROM classified c JOIN raw_draws r ON r.lottery_id = c.lottery_id AND r.row_number = c.row_number
        WHERE status = 'imported'""",
)
def _(t):
    valid = ingest.validate_rows(t.raw_draws, t.lottery).where(F.size("errors") == 0)
    fresh = ingest.append_new_draws(ingest.normalize_rows(valid), existing(t))
    return fresh.select("lottery_id", "draw_number", "row_number", "draw_date")


@job(
    "check_draw_rules",
    """SELECT b.lottery_id, b.draw_number, concat_ws(',', CASE WHEN m.c <> 4 THEN 'count' END,
              CASE WHEN b.super_number > 12 THEN 'super' END) AS broken
       FROM baskets b JOIN (SELECT draw_number, count(*) AS c FROM numbers GROUP BY 1) m
         ON m.draw_number = b.draw_number
       WHERE m.c <> 4 OR b.super_number > 12""",
)
def _(t):
    narrow = t.lottery.withColumn("super_max", F.lit(12))
    out = ingest.check_draw_rules(t.baskets, narrow)
    return out.withColumn("broken", F.array_join("broken", ","))


@job(
    "import_run_state",
    """log AS (
      SELECT d.lottery_id, l_orderkey AS run_id, l_linenumber AS seq,
             CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'completed' WHEN 'RO' THEN 'failed'
               ELSE 'in_progress' END AS status
      FROM lineitem JOIN draws d ON d.draw_number = l_orderkey),
    state AS (
      SELECT lottery_id, run_id,
             coalesce(min({'k': seq, 's': status}) FILTER (status <> 'in_progress'),
                      max({'k': seq, 's': status})).s AS state
      FROM log GROUP BY 1, 2)
    SELECT lottery_id, run_id, state, state = 'in_progress' AND run_id >
           min(CASE WHEN state = 'in_progress' THEN run_id END) OVER (PARTITION BY lottery_id) AS blocked
    FROM state""",
)
def _(t):
    flag = F.concat("l_returnflag", "l_linestatus")
    log = t.raw("lineitem").join(
        t.draws.select("lottery_id", F.col("draw_number").alias("l_orderkey")), "l_orderkey"
    ).select(
        "lottery_id",
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("seq"),
        F.when(flag == "AF", "completed")
        .when(flag == "RO", "failed")
        .otherwise("in_progress")
        .alias("status"),
    )
    return ingest.import_run_state(log)


SELECTION = """
selection AS (
  SELECT lottery_id, draw_number, draw_date,
         row_number() OVER (PARTITION BY lottery_id ORDER BY draw_number) - 1 AS composition_id
  FROM draws WHERE NOT is_deleted AND draw_date BETWEEN date '1996-01-01' AND date '1997-12-31')"""


def selection(t):
    return datasets.select_dataset(t.draws, "1996-01-01", "1997-12-31")


@job("select_dataset", f"{SELECTION} SELECT lottery_id, draw_number, draw_date FROM selection")
def _(t):
    return selection(t).orderBy("draw_number")


@job(
    "dedupe_keep_first",
    """SELECT user_id, first_seq, row_number() OVER (ORDER BY first_seq) - 1 AS composition_id
       FROM (SELECT user_id, min(event_id) AS first_seq FROM events GROUP BY 1)""",
)
def _(t):
    return datasets.dedupe_keep_first(t.raw("events"), "user_id", "event_id")


def cell(kind: str, value: str) -> str:
    """The text of a cell in a row digest."""
    text = f"cast({value} AS varchar)"
    return f"coalesce('{kind}' || strlen({text}) || ':' || {text}, '-')"


def row_sql(*cells: tuple[str, str]) -> str:
    return "sha256(" + " || ".join(cell(*c) for c in cells) + ")"


WORDS = ", ".join(
    f"sum(cast('0x' || substr(digest, {1 + 6 * i}, 6) AS bigint))" for i in range(identity.WORDS)
)
CLOSE = f"sha256(concat_ws('|', count(*), {WORDS}))"


@job(
    "dataset_checksum",
    f"""{SELECTION}, hashed AS (
      SELECT lottery_id, {row_sql(("s", "'1996..1997'"), ("s", "'gen-1'"), ("i", "composition_id"), ("i", "draw_number"))} AS digest
      FROM selection)
    SELECT lottery_id, count(*) AS row_count, {CLOSE} AS fingerprint FROM hashed GROUP BY 1""",
)
def _(t):
    return datasets.dataset_checksum(datasets.compose(selection(t)), "1996..1997", "gen-1")


@job(
    "draws_for_dataset",
    f"""{SELECTION} SELECT s.lottery_id, s.draw_number, s.composition_id, d.draw_date, d.jackpot
        FROM selection s JOIN draws d ON d.draw_number = s.draw_number""",
)
def _(t):
    return datasets.draws_for_dataset(datasets.compose(selection(t)), t.draws)


@job(
    "create_dataset",
    f"""{SELECTION} SELECT lottery_id, draw_number, composition_id FROM selection""",
)
def _(t):
    root = scratch(t, "datasets")
    members = datasets.compose(selection(t)).select("lottery_id", "draw_number", "composition_id")
    manifest = datasets.dataset_checksum(members, "1996..1997", "gen-1")
    path = sinks.create_dataset(members, root, "two_years", 1, manifest)
    return t.spark.read.parquet(path)


DRAW_ROW = row_sql(("i", "lottery_id"), ("i", "draw_number"), ("D", "draw_date"), ("i", "winners"), ("b", "is_deleted"))


@job("row_digest", f"SELECT draw_number, {DRAW_ROW} AS digest FROM draws")
def _(t):
    cols = ["lottery_id", "draw_number", "draw_date", "winners", "is_deleted"]
    return t.draws.select("draw_number", row_digest(*[F.col(c) for c in cols]).alias("digest"))


FINGERPRINT = f"""
hashed AS (
  SELECT lottery_id, {DRAW_ROW} AS digest FROM draws),
prints AS (SELECT lottery_id, count(*) AS row_count, {CLOSE} AS fingerprint FROM hashed GROUP BY 1)"""
DRAW_COLUMNS = ["lottery_id", "draw_number", "draw_date", "winners", "is_deleted"]


@job("table_fingerprint", f"{FINGERPRINT} SELECT * FROM prints")
def _(t):
    return identity.table_fingerprint(t.draws, DRAW_COLUMNS, ["lottery_id"])


@job(
    "input_fingerprint",
    f"""{FINGERPRINT} SELECT lottery_id,
          {row_sql(("s", "'cut'"), ("i", "80"), ("s", "'model'"), ("s", "'empirical'"), ("s", "fingerprint"), ("s", "'gen-1'"))}
            AS fingerprint FROM prints""",
)
def _(t):
    prints = identity.table_fingerprint(t.draws, DRAW_COLUMNS, ["lottery_id"])
    made = identity.input_fingerprint(
        {"model": "empirical", "cut": 80}, F.col("fingerprint"), "gen-1"
    )
    return prints.select("lottery_id", made.alias("fingerprint"))


SNAPSHOTS = """
snapshots AS (
  SELECT concat('customer-', o_custkey) AS scope, o_orderkey AS version,
         md5(cast(o_custkey % 7 AS varchar) || o_orderpriority) AS fingerprint,
         CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'F' THEN 'retired' ELSE 'active' END AS status
  FROM orders)"""


def snapshots(t):
    status = (
        F.when(F.col("o_orderstatus") == "P", "failed")
        .when(F.col("o_orderstatus") == "F", "retired")
        .otherwise("active")
    )
    return t.raw("orders").select(
        F.concat(F.lit("customer-"), "o_custkey").alias("scope"),
        F.col("o_orderkey").alias("version"),
        F.md5(F.concat((F.col("o_custkey") % 7).cast("string"), "o_orderpriority")).alias(
            "fingerprint"
        ),
        status.alias("status"),
    )


@job(
    "active_snapshot",
    f"""{SNAPSHOTS} SELECT scope, version, fingerprint FROM (
      SELECT *, row_number() OVER (PARTITION BY scope ORDER BY version DESC) AS r FROM snapshots
      WHERE status = 'active') WHERE r = 1""",
)
def _(t):
    return identity.active_snapshot(snapshots(t))


@job(
    "find_by_fingerprint",
    f"""{SNAPSHOTS} SELECT s.scope, s.version, s.fingerprint FROM snapshots s WHERE status = 'active'
        AND (scope, fingerprint) IN (SELECT scope, fingerprint FROM snapshots WHERE status = 'failed')""",
)
def _(t):
    log = snapshots(t)
    wanted = log.where("status = 'failed'").select("scope", "fingerprint").distinct()
    return identity.find_by_fingerprint(log, wanted).select("scope", "version", "fingerprint")


@job("next_version", f"{SNAPSHOTS} SELECT scope, max(version) + 1 AS next_version FROM snapshots GROUP BY 1")
def _(t):
    return identity.next_version(snapshots(t))


@job(
    "retire_versions",
    f"""{SNAPSHOTS} SELECT scope, version, CASE WHEN status = 'active' AND version <
          max(CASE WHEN status = 'active' THEN version END) OVER (PARTITION BY scope)
          THEN 'retired' ELSE status END AS status FROM snapshots""",
)
def _(t):
    return identity.retire_versions(snapshots(t))


@job(
    "expired_versions",
    f"""{SNAPSHOTS} SELECT scope, version FROM (
      SELECT *, row_number() OVER (PARTITION BY scope ORDER BY version DESC) AS r FROM snapshots
      WHERE status = 'retired') WHERE r > 3""",
)
def _(t):
    return identity.expired_versions(snapshots(t), keep=3)


@job(
    "list_snapshots",
    f"""{SNAPSHOTS} SELECT scope, version, status FROM snapshots
        WHERE scope = 'customer-7' ORDER BY version DESC""",
)
def _(t):
    log = snapshots(t).where(F.col("scope") == "customer-7")
    return log.select("scope", "version", "status").orderBy(F.desc("version"))


@job(
    "snapshot_diff",
    """older AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_shipdate < timestamp '1999-01-01'),
    newer AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_shipdate >= timestamp '1998-01-01')
    SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS change,
           abs(d) AS copies
    FROM (SELECT l_returnflag, l_linestatus, l_quantity, sum(s) AS d FROM
          (SELECT *, -1 AS s FROM older UNION ALL SELECT *, 1 FROM newer) GROUP BY 1, 2, 3) WHERE d <> 0""",
)
def _(t):
    cols = ["l_returnflag", "l_linestatus", "l_quantity"]
    lines = t.raw("lineitem")
    old = lines.where("l_shipdate < timestamp_ntz '1999-01-01'").select(*cols)
    new = lines.where("l_shipdate >= timestamp_ntz '1998-01-01'").select(*cols)
    return identity.snapshot_diff(old, new)
