"""Validation and import of all-text draw rows as data-quality jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urnframe.plans.joins import with_dimension

KEY = ["lottery_id", "draw_number"]
BLANKS = " \t\r\n"
DIGITS = "^[0-9]+$"
POSITIVE = "^[0-9]*[1-9][0-9]*$"
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DECIMAL = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?|[nN]a[nN])$"
TERMINAL = ["completed", "failed"]


def strip(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")), F.lit(BLANKS))


def split_tokens() -> Column:
    parts = F.transform(
        F.split(F.coalesce("numbers", F.lit("")), ","), lambda p: F.trim(p, F.lit(BLANKS))
    )
    return F.filter(parts, lambda p: p != "")


def digit_values() -> Column:
    """Integer tokens; one too long for a bigint counts as the largest bigint."""
    digits = F.filter("_tokens", lambda p: p.rlike(DIGITS))
    return F.transform(digits, lambda p: F.coalesce(p.try_cast("long"), F.lit(2**63 - 1)))


def with_tokens(raw: DataFrame) -> DataFrame:
    """Split the number cell once; the checks share the result."""
    split = raw.withColumn("_tokens", split_tokens())
    return split.withColumn("_values", digit_values())


def error(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def _one(broken: Column, code: str, message: Column) -> Column:
    return F.when(broken, F.array(error(code, message)))


def _fits(raw: Column, kind: str) -> Column:
    """Whether a well-formed cell has a value of the column's type."""
    return raw.try_cast(kind).isNotNull()


def bad_row_number() -> Column:
    """No positive whole number, or one that the key column cannot hold."""
    return _one(
        ~strip("draw_number").rlike(POSITIVE) | ~_fits(strip("draw_number"), "long"),
        "bad_row_number",
        F.concat(F.lit("draw number: "), strip("draw_number")),
    )


def bad_draw_date() -> Column:
    raw = strip("draw_date")
    wrong = ~raw.rlike(ISO_DATE) | F.try_to_date(raw, "yyyy-MM-dd").isNull()
    return _one(wrong, "bad_draw_date", F.concat(F.lit("draw date: "), raw))


def number_out_of_range() -> Column:
    """One error per token that is no integer or lies outside the lottery's range."""

    def wrong(token: Column) -> Column:
        value = token.try_cast("long")
        inside = value.between(F.col("min_number"), F.col("max_number"))
        return ~token.rlike(DIGITS) | ~F.coalesce(inside, F.lit(False))

    bad = F.filter("_tokens", wrong)
    return F.transform(
        bad, lambda p: error("number_out_of_range", F.concat(F.lit("number: "), p))
    )


def wrong_count() -> Column:
    n = F.size("_values")
    text = F.concat(n.cast("string"), F.lit(" of "), F.col("numbers_to_select").cast("string"))
    few = F.array(error("too_few_numbers", text))
    many = F.array(error("too_many_numbers", text))
    return F.when(n < F.col("numbers_to_select"), few).when(n > F.col("numbers_to_select"), many)


def duplicate_in_draw() -> Column:
    repeated = F.size(F.array_distinct("_values")) < F.size("_values")
    return _one(repeated, "duplicate_in_draw", F.lit("a number repeats"))


def bad_super_number() -> Column:
    raw = strip("super_number")
    inside = raw.try_cast("long").between(F.col("super_min"), F.col("super_max"))
    ok = raw.rlike(DIGITS) & F.coalesce(inside, F.lit(False))
    return _one((raw != "") & ~ok, "bad_super_number", F.concat(F.lit("super number: "), raw))


def bad_jackpot() -> Column:
    """No decimal, or one that the column cannot hold: not a number, infinite, too large."""
    raw = strip("jackpot")
    ok = raw.rlike(DECIMAL) & _fits(raw, "decimal(18,2)")
    return _one(
        (raw != "") & ~ok, "bad_jackpot", F.concat(F.lit("jackpot: "), raw)
    )


def bad_winners() -> Column:
    raw = strip("winners")
    ok = raw.rlike(DIGITS) & _fits(raw, "long")
    return _one((raw != "") & ~ok, "bad_winners", F.concat(F.lit("winners: "), raw))


# Checks in the order their errors are reported.
CHECKS = {
    "bad_row_number": bad_row_number,
    "bad_draw_date": bad_draw_date,
    "number_out_of_range": number_out_of_range,
    "wrong_count": wrong_count,
    "duplicate_in_draw": duplicate_in_draw,
    "bad_super_number": bad_super_number,
    "bad_jackpot": bad_jackpot,
    "bad_winners": bad_winners,
}


def validate_rows(raw: DataFrame, lottery: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """Add ``errors``: every failed check of the row, in check order. One narrow pass."""
    rules = lottery.drop("code")
    found = [CHECKS[c]() for c in (checks or CHECKS)]
    empty = F.array().cast("array<struct<code:string,message:string>>")
    errors = F.flatten(F.array(*[F.coalesce(e, empty) for e in found]))
    ruled = with_tokens(with_dimension(raw, rules, "lottery_id"))
    return ruled.select(*[F.col(c) for c in raw.columns], errors.alias("errors"))


def rows_with(raw: DataFrame, lottery: DataFrame, check: str) -> DataFrame:
    """(row, error code, how many) of one check."""
    hits = validate_rows(raw, lottery, [check]).where(F.size("errors") > 0)
    return hits.select(
        "lottery_id",
        "row_number",
        F.col("errors")[0]["code"].alias("code"),
        F.size("errors").cast("long").alias("n"),
    )


def normalize_rows(raw: DataFrame) -> DataFrame:
    """Typed columns; anything unreadable or blank becomes null."""
    return with_tokens(raw).select(
        "lottery_id",
        "row_number",
        strip("draw_number").try_cast("long").alias("draw_number"),
        F.try_to_date(strip("draw_date"), "yyyy-MM-dd").alias("draw_date"),
        F.transform("_values", lambda v: v.try_cast("int")).alias("numbers"),
        strip("super_number").try_cast("int").alias("super_number"),
        strip("jackpot").try_cast("decimal(18,2)").alias("jackpot"),
        strip("winners").try_cast("long").alias("winners"),
    )


def classify_rows(validated: DataFrame, existing: DataFrame) -> DataFrame:
    """Status per row: error, duplicate (key known, or valid earlier in the file) or imported.

    The first valid row of a key comes from a combining aggregate, never from a sorted group,
    so a key with a third of all rows costs one row per task. Rows with errors get a key of
    their own and cannot pile up under a null key in the join.
    """
    ok = (F.size("errors") == 0) & _fits(strip("draw_number"), "long")  # checks may have been left out
    key = F.when(ok, strip("draw_number").try_cast("long")).otherwise(-F.col("row_number"))
    keyed = validated.select("lottery_id", "row_number", key.alias("draw_number"), ok.alias("_ok"))
    known = existing.select(*KEY, F.lit(True).alias("_known"))
    firsts = (
        keyed.where("_ok")
        .groupBy(*KEY)
        .agg(F.min("row_number").alias("_first"))
        .join(known, KEY, "left")
    )
    repeat = F.col("_known").isNotNull() | (F.col("row_number") > F.col("_first"))
    status = F.when(~F.col("_ok"), "error").when(repeat, "duplicate").otherwise("imported")
    return keyed.join(firsts, KEY, "left").select(
        "lottery_id",
        "row_number",
        F.when(F.col("_ok"), F.col("draw_number")).alias("draw_number"),
        status.alias("status"),
    )


def import_counters(classified: DataFrame, skipped: int = 0) -> DataFrame:
    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return classified.groupBy("lottery_id").agg(
        (F.count("*") + skipped).alias("total_rows"),
        of("imported").alias("imported_rows"),
        F.lit(skipped).cast("long").alias("skipped_rows"),
        of("duplicate").alias("duplicate_rows"),
        of("error").alias("error_rows"),
        F.max("row_number").alias("last_processed_row"),
    )


def resume_import(raw: DataFrame, runs: DataFrame, identity: dict[str, str]) -> DataFrame:
    """Rows after the last processed one of the newest unfinished run with this identity."""
    same = runs.where(~F.col("status").isin(TERMINAL))
    for name, value in identity.items():
        same = same.where(F.col(name) == value)
    points = same.groupBy("lottery_id").agg(
        F.max_by("last_processed_row", "run_id").alias("_after")
    )
    joined = with_dimension(raw, points, "lottery_id", "left")
    return joined.where(F.col("row_number") > F.coalesce("_after", F.lit(0))).drop("_after")


def append_new_draws(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """First row of every natural key that the table does not hold yet. Rows without a key are no draws."""
    others = [c for c in rows.columns if c not in KEY]
    keyed = rows.where(F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull())
    first = keyed.groupBy(*KEY).agg(F.min_by(F.struct(*others), "row_number").alias("_r"))
    fresh = first.join(existing.select(*KEY), KEY, "left_anti")
    return fresh.select(*KEY, "_r.*")


def check_draw_rules(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    """Typed draws with every broken rule named, in a fixed order."""
    n = F.size("numbers")
    low, high = F.col("min_number"), F.col("max_number")
    inside = F.forall("numbers", lambda x: x.between(low, high))
    ruled = with_dimension(baskets, lottery.drop("code"), "lottery_id")
    super_ok = F.col("super_number").isNull() | F.col("super_number").between(
        F.col("super_min"), F.col("super_max")
    )
    broken = F.filter(
        F.array(
            F.when(n != F.col("numbers_to_select"), "count"),
            F.when(~inside, "range"),
            F.when(F.size(F.array_distinct("numbers")) < n, "distinct"),
            F.when(~F.coalesce(super_ok, F.lit(False)), "super"),
        ),
        lambda c: c.isNotNull(),
    )
    return ruled.select(*KEY, broken.alias("broken")).where(F.size("broken") > 0)


def import_run_state(log: DataFrame) -> DataFrame:
    """Current state per run from an append-only log.

    The first terminal state stays whatever is logged later. Of several runs in progress in
    one lottery only the lowest run id may go on; the others are blocked.
    """
    order = F.struct("seq", "status")
    ended = F.col("status").isin(TERMINAL)
    state = log.groupBy("lottery_id", "run_id").agg(
        F.min_by("status", F.when(ended, order)).alias("_end"),
        F.max_by("status", order).alias("_last"),
    )
    state = state.select("lottery_id", "run_id", F.coalesce("_end", "_last").alias("state"))
    holder = (
        state.where(F.col("state") == "in_progress")
        .groupBy("lottery_id")
        .agg(F.min("run_id").alias("_holder"))
    )
    held = (F.col("state") == "in_progress") & (F.col("run_id") > F.col("_holder"))
    return with_dimension(state, holder, "lottery_id", "left").select(
        "lottery_id", "run_id", "state", F.coalesce(held, F.lit(False)).alias("blocked")
    )
