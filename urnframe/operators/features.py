"""Per-draw features and the long and wide feature tables.

The basket features are column expressions over one small array: no shuffle. The series
features run through the chunked scans of ``plans.series``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from urnframe.functions.columns import quantize
from urnframe.plans.joins import with_dimension
from urnframe.plans.series import running
from urnframe.session import checkpoint_frame

KEY = ["lottery_id", "draw_number"]

# Fixed column order of the feature matrix.
FEATURE_ORDER = [
    "draw_sum",
    "draw_mean",
    "draw_range",
    "odd_even_ratio",
    "low_high_ratio",
    "consecutive_count",
    "repeated_from_previous",
    "max_current_gap",
]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x)


def draw_sum() -> Column:
    return total(F.col("numbers"))


def draw_mean() -> Column:
    n = F.size("numbers")
    return F.when(n == 0, F.lit(0.0)).otherwise(draw_sum() / n)


def draw_range() -> Column:
    spread = F.array_max("numbers") - F.array_min("numbers")
    return F.coalesce(spread, F.lit(0)).cast("long")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, top.cast("double")).otherwise(top / bottom)


def odd_even_ratio() -> Column:
    odd = F.size(F.filter("numbers", lambda x: x % 2 != 0))
    return _ratio(odd, F.size("numbers") - odd)


def low_high_ratio() -> Column:
    mid = F.floor((F.col("min_number") + F.col("max_number")) / 2)
    low = F.size(F.filter("numbers", lambda x: x <= mid))
    return _ratio(low, F.size("numbers") - low)


def consecutive_count() -> Column:
    s, n = F.sort_array("numbers"), F.size("numbers")
    steps = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: b - a)
    found = F.size(F.filter(steps, lambda d: d == 1))
    return F.when(n < 2, F.lit(0)).otherwise(found).cast("long")


BASKET_FEATURES: dict[str, Callable[[], Column]] = {
    "draw_sum": draw_sum,
    "draw_mean": draw_mean,
    "draw_range": draw_range,
    "odd_even_ratio": odd_even_ratio,
    "low_high_ratio": low_high_ratio,
    "consecutive_count": consecutive_count,
}


def register_feature(name: str, builder: Callable[[], Column]) -> None:
    """Add a column feature over ``numbers`` and the lottery's rules."""
    if name in BASKET_FEATURES:
        raise ValueError(f"feature {name} exists")
    BASKET_FEATURES[name] = builder


def basket_features(baskets: DataFrame, lottery: DataFrame, names: Iterable[str] | None = None):
    """Column features of every draw in one narrow pass."""
    names = list(names or BASKET_FEATURES)
    ruled = with_dimension(baskets, lottery.select("lottery_id", "min_number", "max_number"), "lottery_id")
    return ruled.select(*KEY, *[BASKET_FEATURES[n]().alias(n) for n in names])


def decade_distribution(baskets: DataFrame) -> DataFrame:
    """Map of band start (1, 11, 21, ...) to how many numbers of the draw fall in it."""
    bands = F.transform("numbers", lambda x: F.floor((x - 1) / 10).cast("int") * 10 + 1)
    starts = F.sort_array(F.array_distinct("_bands"))
    counted = F.transform(
        starts,
        lambda b: F.struct(
            b.alias("band"), F.size(F.filter("_bands", lambda x: x == b)).cast("long").alias("n")
        ),
    )
    return baskets.select(*KEY, bands.alias("_bands")).select(
        *KEY, F.map_from_entries(counted).alias("decades")
    )


def repeated_from_previous(baskets: DataFrame) -> DataFrame:
    """Size of the overlap with the draw before; 0 for the first one."""
    rows = baskets.select(*KEY, "numbers")
    seen = running(
        rows, ["lottery_id"], "draw_number", {"prev": ("last", F.col("numbers"))}, exclusive=True
    )
    overlap = F.coalesce(F.size(F.array_intersect("numbers", "prev")), F.lit(0))
    overlap = F.when(F.col("prev").isNull(), F.lit(0)).otherwise(overlap)
    return seen.select(*KEY, overlap.cast("long").alias("repeated_from_previous"))


def max_current_gap(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    """Largest distance, in draw numbers, since any number of the universe last appeared.

    An appearance covers the draws up to the next one of its number, so the oldest "last seen"
    at draw d is the least appearance whose successor lies after d. That is a running minimum
    from the end of the series over one value per draw: no draws x universe grid.
    """
    rules = lottery.select("lottery_id", "min_number", "max_number")
    firsts = baskets.groupBy("lottery_id").agg(F.min("draw_number").alias("first"))
    exploded = baskets.select(*KEY, F.explode("numbers").alias("number"))
    inside = F.col("number").between(F.col("min_number"), F.col("max_number"))
    seen = with_dimension(exploded, rules, "lottery_id").where(inside).select(*KEY, "number")
    with_prev = running(
        seen,
        ["lottery_id", "number"],
        "draw_number",
        {"prev": ("last", F.col("draw_number"))},
        exclusive=True,
    )
    # A number's first appearance closes the interval that began with the series.
    closed = checkpoint_frame(
        with_prev.groupBy(*KEY).agg(
            F.min("prev").alias("oldest"), F.max(F.col("prev").isNull()).alias("opens")
        )
    )
    per_number = seen.groupBy("lottery_id", "number").agg(F.max("draw_number").alias("last_at"))
    tails = (
        per_number.groupBy("lottery_id")
        .agg(F.min("last_at").alias("tail"), F.count("*").alias("seen_numbers"))
        .join(rules, "lottery_id")
        .join(firsts, "lottery_id", "right")
        .select(
            "lottery_id",
            "first",
            F.when(
                F.col("seen_numbers") == F.col("max_number") - F.col("min_number") + 1,
                F.col("tail"),
            )
            .otherwise(F.col("first"))
            .alias("tail"),
        )
    )
    per_draw = with_dimension(
        baskets.select(*KEY).join(closed.hint("merge"), KEY, "left"), tails, "lottery_id"
    ).select(
        *KEY,
        "tail",
        (-F.col("draw_number")).alias("_back"),
        F.when(F.col("opens"), F.col("first")).otherwise(F.col("oldest")).alias("oldest"),
    )
    scanned = running(
        per_draw, ["lottery_id"], "_back", {"pending": ("min", F.col("oldest"))}, exclusive=True
    )
    oldest = F.least("pending", "tail")
    return scanned.select(*KEY, (F.col("draw_number") - oldest).alias("max_current_gap"))


COUNT_BITS = 14  # draws with numbers of one range of this width are counted in one group


def running_frequencies(draws: DataFrame, keep: Iterable[str] = (), bits: int = COUNT_BITS) -> DataFrame:
    """Appearances so far of every number of the lottery at every draw, as arrays: one row per draw.

    ``seen_numbers`` are the numbers that the lottery has ever shown, in rising order, and
    ``frequencies`` their counts up to and with the draw. Draws are counted in ranges of draw numbers;
    a range's carry is a running count over the ranges before it, so only the draws themselves
    and ranges x universe are shuffled, never draws x universe.
    """
    keep = list(keep)
    chunk = F.shiftright(F.col("draw_number").cast("long"), bits).alias("_chunk")
    rows = draws.select(F.col("lottery_id").cast("int").alias("lottery_id"), F.col("draw_number").cast("long").alias("draw_number"), chunk, "numbers", *keep)
    rows = rows.where(F.col("lottery_id").isNotNull() & F.col("draw_number").isNotNull())
    members = rows.select("lottery_id", "_chunk", F.explode("numbers").alias("number")).where(F.col("number").isNotNull())
    found = checkpoint_frame(members.groupBy("lottery_id", "_chunk", "number").agg(F.count("*").alias("_n")))
    seen = found.groupBy("lottery_id", "number").agg(F.lit(0).cast("long").alias("_zero")).drop("_zero")
    chunks = rows.groupBy("lottery_id", "_chunk").agg(F.lit(1).alias("_one")).drop("_one")
    grid = chunks.join(seen, "lottery_id", "left").join(found, ["lottery_id", "_chunk", "number"], "left")
    carried = running(
        grid.withColumn("_n", F.coalesce("_n", F.lit(0))), ["lottery_id", "number"], "_chunk", {"_before": ("sum", F.col("_n"))},
        exclusive=True,
    ).select("lottery_id", "_chunk", F.col("number").cast("int").alias("number"), F.col("_before").cast("long").alias("_before"))
    carried = checkpoint_frame(carried)  # a row per range and number

    schema = rows.drop("_chunk").schema.add("seen_numbers", ArrayType(IntegerType())).add("frequencies", ArrayType(LongType()))

    def counted(own: pa.Table, carry: pa.Table) -> pa.Table:
        own, carry = own.sort_by("draw_number"), carry.filter(pc.is_valid(carry["number"])).sort_by("number")
        numbers, before = np.asarray(carry["number"]), np.asarray(carry["_before"])
        listed = own["numbers"].combine_chunks()
        flat, of = pc.list_flatten(listed), pc.list_parent_indices(listed)
        known = pc.is_valid(flat)
        hits = np.zeros((len(own), len(numbers)), np.int64)
        hits[np.asarray(of.filter(known)), np.searchsorted(numbers, np.asarray(flat.filter(known)))] = 1
        ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(numbers))
        counts = np.cumsum(hits, axis=0) + before
        universe = pa.ListArray.from_arrays(ends, pa.array(np.tile(numbers, len(own)), pa.int32()))
        return own.drop(["_chunk"]).append_column("seen_numbers", universe).append_column(
            "frequencies", pa.ListArray.from_arrays(ends, pa.array(counts.ravel(), pa.int64()))
        )

    keys = ["lottery_id", "_chunk"]
    return rows.groupBy(*keys).cogroup(carried.groupBy(*keys)).applyInArrow(counted, schema)


def current_frequency(baskets: DataFrame) -> DataFrame:
    """Appearances so far of every number seen so far, at every draw (long form)."""
    counted = running_frequencies(baskets.select(*KEY, "numbers"))
    every = counted.select(*KEY, F.explode(F.arrays_zip("seen_numbers", "frequencies")).alias("c"))
    return every.select(
        *KEY, F.col("c.seen_numbers").alias("number"), F.col("c.frequencies").alias("frequency")
    ).where(F.col("frequency") > 0)


def current_frequency_map(baskets: DataFrame) -> DataFrame:
    """``current_frequency`` as one map per draw, at most one entry per number."""
    counted = running_frequencies(baskets.select(*KEY, "numbers"))
    entries = F.zip_with(
        "seen_numbers", "frequencies", lambda number, n: F.struct(number.alias("number"), n.alias("frequency"))
    )
    kept = F.filter(entries, lambda e: e["frequency"] > 0)
    return counted.where(F.exists("frequencies", lambda n: n > 0)).select(
        *KEY, F.map_from_entries(kept).alias("current_frequency")
    )


def feature_frame(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    """All scalar features of every draw, wide."""
    return (
        basket_features(baskets, lottery)
        .join(repeated_from_previous(baskets).hint("merge"), KEY)
        .join(max_current_gap(baskets, lottery).hint("merge"), KEY)
    )


def feature_values(features: DataFrame, version: int = 1) -> DataFrame:
    """Long form (feature_id, version, draw, value) of a wide feature frame."""
    names = [c for c in features.columns if c not in KEY]
    wide = features.select(*KEY, *[F.col(n).cast("double").alias(n) for n in names])
    long = wide.unpivot(KEY, names, "feature_id", "value")
    return long.select(
        "feature_id", F.lit(version).alias("version"), *KEY, quantize("value").alias("value")
    )


def feature_matrix(values: DataFrame) -> DataFrame:
    """Wide matrix in the fixed column order; a missing cell fails the job."""
    wide = values.groupBy(*KEY).pivot("feature_id", FEATURE_ORDER).agg(F.first("value"))

    def cell(name: str) -> Column:
        missing = F.raise_error(F.format_string("draw %d has no %s", "draw_number", F.lit(name)))
        return F.coalesce(F.col(name).cast("double"), missing.cast("double")).alias(name)

    return wide.select(*KEY, *[cell(n) for n in FEATURE_ORDER])


def draw_correlation(counts: DataFrame, pairs: DataFrame, scope: DataFrame) -> DataFrame:
    """Correlation of the 0/1 participation of two numbers over all draws of a lottery.

    Derived from single and pair counts, which are bounded by the universe.
    """
    left = counts.select("lottery_id", F.col("number").alias("a"), F.col("n").alias("na"))
    right = counts.select("lottery_id", F.col("number").alias("b"), F.col("n").alias("nb"))
    n, na, nb = (F.col(c).cast("double") for c in ("draw_count", "na", "nb"))
    both = F.coalesce(F.col("weight"), F.lit(0)).cast("double")
    spread = F.sqrt(na * (n - na) * nb * (n - nb))
    every = left.join(right, "lottery_id").where(F.col("a") < F.col("b"))
    return (
        every.join(pairs, ["lottery_id", "a", "b"], "left")
        .join(scope.select("lottery_id", "draw_count"), "lottery_id")
        .select("lottery_id", "a", "b", ((n * both - na * nb) / spread).alias("correlation"))
    )
