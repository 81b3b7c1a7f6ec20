"""The supplied order and event tables seen as draw histories.

An order is a draw, its priority is the lottery, its line items are the numbers. Only columns
are derived here; every operator takes plain DataFrames and knows nothing of these tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.plans.joins import checked_broadcast
from urnframe.session import checkpoint_frame

# Fixed rules of the derived lotteries.
MIN_NUMBER, MAX_NUMBER, NUMBERS_TO_SELECT, SUPER_MIN, SUPER_MAX = 1, 45, 4, 1, 16

RULES = ["lottery_id", "code", "min_number", "max_number", "numbers_to_select", "super_min", "super_max"]


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = str(path).rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def lottery(self) -> DataFrame:
        code = F.col("o_orderpriority")
        rules = (
            self.raw("orders")
            .groupBy(code.alias("code"))
            .agg(F.lit(1).alias("_one"))
            .select(
                F.substring("code", 1, 1).cast("int").alias("lottery_id"),
                "code",
                F.lit(MIN_NUMBER).alias("min_number"),
                F.lit(MAX_NUMBER).alias("max_number"),
                F.lit(NUMBERS_TO_SELECT).alias("numbers_to_select"),
                F.lit(SUPER_MIN).alias("super_min"),
                F.lit(SUPER_MAX).alias("super_max"),
            )
        )
        return checked_broadcast(rules)

    @cached_property
    def draws(self) -> DataFrame:
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("lottery_id"),
            key.alias("draw_number"),
            F.to_date("o_orderdate").alias("draw_date"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("jackpot"),
            F.when(customer % 3 != 0, customer % 10).alias("winners"),
            (customer % 16 + 1).cast("int").alias("super_number"),
            (key % 50 == 49).alias("is_deleted"),
        )

    @cached_property
    def _members(self) -> DataFrame:
        """Distinct (draw, number) with the first line it is on; combined before the shuffle."""
        return (
            self.raw("lineitem")
            .groupBy(
                F.col("l_orderkey").alias("draw_number"),
                (F.col("l_partkey") % MAX_NUMBER + 1).cast("int").alias("number"),
            )
            .agg(F.min("l_linenumber").alias("line"))
        )

    @cached_property
    def _picked(self) -> DataFrame:
        """One row per draw with its numbers in position order; at most 45 of them."""
        ordered = F.sort_array(F.collect_list(F.struct("line", "number")))
        return self._members.groupBy("draw_number").agg(ordered["number"].alias("numbers"))

    @cached_property
    def all_baskets(self) -> DataFrame:
        """Draws that have numbers, deleted ones included."""
        return self.draws.join(self._picked, "draw_number").select(*self.draws.columns, "numbers")

    @cached_property
    def visible(self) -> DataFrame:
        """Visible draws with their numbers, for jobs that read them once."""
        kept = self.draws.where(~F.col("is_deleted")).drop("is_deleted")
        return kept.join(self._picked, "draw_number").select(*kept.columns, "numbers")

    @cached_property
    def baskets(self) -> DataFrame:
        """``visible`` as a written table, for jobs that pass over it several times.

        The line items are then grouped once, and every pass reads only its own columns.
        """
        return checkpoint_frame(self.visible)

    @cached_property
    def draw_numbers(self) -> DataFrame:
        """Long form: one row per (draw, position), deleted draws included."""
        return self.all_baskets.select(
            "lottery_id", "draw_number", F.posexplode("numbers").alias("pos", "number")
        ).select("lottery_id", "draw_number", (F.col("pos") + 1).alias("position"), "number")

    @cached_property
    def numbers(self) -> DataFrame:
        """Long form of the visible draws."""
        return self.visible.select(
            "lottery_id", "draw_number", F.posexplode("numbers").alias("pos", "number")
        ).select("lottery_id", "draw_number", (F.col("pos") + 1).alias("position"), "number")

    @cached_property
    def dated_draws(self) -> DataFrame:
        """Visible draws of the backtests, numbers in rising order, as a written table."""
        return checkpoint_frame(
            self.visible.select("lottery_id", "draw_number", "draw_date", F.sort_array("numbers").alias("numbers"))
        )

    @cached_property
    def raw_draws(self) -> DataFrame:
        """All-text rows as an import file would hold them, with faults in every column."""
        tokens = (
            self.raw("lineitem")
            .groupBy(
                F.col("l_orderkey").alias("o_orderkey"),
                F.col("l_linenumber").alias("line"),
                (F.col("l_partkey") % MAX_NUMBER + 1).cast("int").alias("number"),
            )
            .agg(F.lit(1).alias("_one"))
            .groupBy("o_orderkey")
            .agg(F.sort_array(F.collect_list(F.struct("line", "number")))["number"].alias("tokens"))
        )
        key = F.col("o_orderkey")
        plain = F.array_join(F.col("tokens").cast("array<string>"), ",")
        base = self.raw("orders").join(tokens, "o_orderkey", "left")
        rows = base.select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("lottery_id"),
            key.alias("_key"),
            F.when(key % 101 == 0, "abc")
            .when(key % 103 == 0, "-5")
            .otherwise(key.cast("string"))
            .alias("draw_number"),
            F.when(key % 97 == 0, "2023-13-40")
            .when(key % 89 == 0, "05/01/2024")
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
            .alias("draw_date"),
            F.when(key % 83 == 0, F.concat_ws(",", plain, F.lit("x")))
            .when(key % 79 == 0, F.concat_ws(",", plain, F.lit("99")))
            .when(key % 73 == 0, F.concat_ws(",", F.lit(" "), plain, F.lit("")))
            .otherwise(F.coalesce(plain, F.lit("")))
            .alias("numbers"),
            F.when(key % 71 == 0, "17")
            .when(key % 67 == 0, "seven")
            .when(key % 5 == 0, "")
            .otherwise((F.col("o_custkey") % 16 + 1).cast("string"))
            .alias("super_number"),
            F.when(key % 61 == 0, "not-a-decimal")
            .when(F.col("o_orderstatus") == "P", "")
            .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
            .alias("jackpot"),
            F.when(key % 59 == 0, "-5")
            .when(F.col("o_custkey") % 3 == 0, " ")
            .otherwise((F.col("o_custkey") % 10).cast("string"))
            .alias("winners"),
        )
        # Every 53rd row comes twice; the second copy has the higher row number.
        copies = F.when(F.col("_key") % 53 == 0, F.array(F.lit(2), F.lit(3))).otherwise(
            F.array(F.lit(2))
        )
        return rows.withColumn("_k", F.explode(copies)).select(
            "lottery_id",
            (F.col("_key") * 2 + F.col("_k")).alias("row_number"),
            "draw_number",
            "draw_date",
            "numbers",
            "super_number",
            "jackpot",
            "winners",
        )

    @cached_property
    def events(self) -> DataFrame:
        """Item events: type, time, item 0..99."""
        item = F.get_json_object("props", "$.k").try_cast("int")
        return self.raw("events").select("event_id", "event_type", "ts", item.alias("item"))
