"""Training sets, splits, sequence windows and classifiers on draw features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnframe.operators import classifiers
from urnframe.operators.features import FEATURE_ORDER, running_frequencies
from urnframe.plans.joins import with_dimension
from urnframe.plans.series import framed, running
from urnframe.session import checkpoint_frame

KEY = ["lottery_id", "draw_number"]
MIN_WINDOW, MAX_WINDOW = 2, 20

SCORED = pa.schema(
    [("lottery_id", pa.int32()), ("draw_number", pa.int64()), ("number", pa.int32())]
    + [(c, pa.float64()) for c in ("label", "score", "prediction")]
)

# Fixed set of the numbers whose next appearance a sequence model predicts.
SEQUENCE_TARGETS = list(range(1, 11))


def with_next(baskets: DataFrame) -> DataFrame:
    """Add the draw's ordinal and the numbers of the draw after it (null for the last one)."""
    ahead = running(
        baskets.withColumn("_back", -F.col("draw_number")),
        ["lottery_id"],
        "_back",
        {"next_numbers": ("last", F.col("numbers"))},
        exclusive=True,
    ).drop("_back")
    # Written once, one row per draw: the scans built on it pass over it several times.
    return checkpoint_frame(
        running(
            ahead,
            ["lottery_id"],
            "draw_number",
            {"idx": ("sum", F.lit(1).cast("long"))},
            exclusive=True,
        )
    )


def next_draw_targets(baskets: DataFrame) -> DataFrame:
    """For every draw but the last and every number ever seen: is it in the next draw."""
    rows = with_next(baskets.select(*KEY, "numbers")).where(F.col("next_numbers").isNotNull())
    # The last draw's numbers belong to the universe too, so the numbers come from all draws.
    seen = (
        baskets.select("lottery_id", F.explode("numbers").alias("number"))
        .groupBy("lottery_id", "number")
        .agg(F.lit(1).alias("_one"))
        .groupBy("lottery_id")
        .agg(F.sort_array(F.collect_list("number")).alias("_seen"))
    )
    label = F.array_contains(F.col("next_numbers"), F.col("number")).cast("int")
    return (
        with_dimension(rows, seen, "lottery_id")
        .select(*KEY, "next_numbers", F.explode("_seen").alias("number"))
        .select(*KEY, "number", label.alias("label"))
    )


def counted_draws(baskets: DataFrame) -> DataFrame:
    """Every labelled draw with the counts so far of all numbers of its lottery, one row per draw."""
    rows = with_next(baskets.select(*KEY, "numbers"))
    counted = running_frequencies(rows, keep=["idx", "next_numbers"])
    return counted.where(F.col("next_numbers").isNotNull()).drop("numbers")


def score_counts(counted: DataFrame) -> DataFrame:
    """The rows of :func:`frequency_scores` of ``counted`` draws; nothing is shuffled."""
    every = counted.select(
        *KEY, "idx", "next_numbers", F.explode(F.arrays_zip("seen_numbers", "frequencies")).alias("c")
    )
    number, seen = F.col("c.seen_numbers"), F.col("c.frequencies")
    label = F.array_contains(F.col("next_numbers"), number).cast("int")
    return every.select(
        *KEY, "idx", number.alias("number"), seen.alias("seen"), (seen / (F.col("idx") + 1)).alias("score"), label.alias("label")
    )


def frequency_scores(baskets: DataFrame) -> DataFrame:
    """Score of every (draw, number): share of the draws so far holding the number."""
    return score_counts(counted_draws(baskets))


def held_out_draws(baskets: DataFrame) -> DataFrame:
    """The counted draws after the cut of their lottery; they are told apart before numbers are spread."""
    split = walk_forward_split(counted_draws(baskets), default_cut(baskets))
    return split.where("segment = 'eval'").drop("segment", "cut")


def default_cut(baskets: DataFrame) -> DataFrame:
    """Per lottery the draw number that ends the first four fifths of its labelled draws."""
    indexed = running(
        baskets.select(*KEY),
        ["lottery_id"],
        "draw_number",
        {"_i": ("sum", F.lit(1).cast("long"))},
        exclusive=True,
    )
    size = baskets.groupBy("lottery_id").agg(F.count("*").alias("_n"))
    at = F.expr("(_n - 1) * 4 div 5 - 1")
    joined = with_dimension(indexed, size.select("lottery_id", at.alias("_at")), "lottery_id")
    return joined.where(F.col("_i") == F.col("_at")).select(
        "lottery_id", F.col("draw_number").alias("cut")
    )


def walk_forward_split(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``segment``: train up to the cut, eval after it."""
    side = F.when(F.col("draw_number") <= F.col("cut"), "train").otherwise("eval")
    return with_dimension(rows, cuts, "lottery_id").withColumn("segment", side)


def require_both_sides(split: DataFrame) -> DataFrame:
    """Fail when a lottery has no training or no evaluation rows."""
    sides = split.groupBy("lottery_id").agg(F.count_distinct("segment").alias("_s"))
    if not sides.where(F.col("_s") < 2).isEmpty():
        raise ValueError("a lottery has an empty train or eval side")
    return split


def leaks(split: DataFrame) -> DataFrame:
    """Evaluation rows that do not lie after the cut."""
    return split.where((F.col("segment") == "eval") & (F.col("draw_number") <= F.col("cut")))


def check_leakage(split: DataFrame) -> DataFrame:
    if not leaks(split).isEmpty():
        raise ValueError("an evaluation draw is not after the cut")
    return split


def sequence_windows(features: DataFrame, idx: DataFrame, width: int) -> DataFrame:
    """Every run of ``width`` consecutive draws as an array of feature vectors.

    ``idx`` has (lottery_id, draw_number, idx). A missing cell counts as 0.
    """
    if not MIN_WINDOW <= width <= MAX_WINDOW:
        raise ValueError(f"window width is {MIN_WINDOW}..{MAX_WINDOW}")
    cells = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURE_ORDER])
    rows = idx.join(features, KEY, "left").select(*KEY, "idx", cells.alias("_x"))

    def build(window):
        frame = window.rowsBetween(-(width - 1), 0)
        return {
            "window": F.collect_list("_x").over(frame),
            "first_draw": F.min("draw_number").over(frame),
        }

    out = framed(rows, ["lottery_id"], "idx", width - 1, build)
    return out.where(F.size("window") == width).select(*KEY, "idx", "first_draw", "window")


def require_draws(baskets: DataFrame, width: int) -> DataFrame:
    short = baskets.groupBy("lottery_id").agg(F.count("*").alias("_n")).where(F.col("_n") < width)
    if not short.isEmpty():
        raise ValueError(f"a lottery has fewer than {width} draws")
    return baskets


def sequence_targets(baskets: DataFrame) -> DataFrame:
    """0/1 per target number for the draw after each draw; the last draw has none."""
    rows = with_next(baskets.select(*KEY, "numbers")).where(F.col("next_numbers").isNotNull())
    marks = [F.array_contains("next_numbers", n).cast("int") for n in SEQUENCE_TARGETS]
    return rows.select(*KEY, F.array(*marks).alias("y"))


def split_windows(windows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Train windows end by the cut, eval windows start after it; straddling ones are dropped."""
    side = F.when(F.col("draw_number") <= F.col("cut"), "train").when(
        F.col("first_draw") > F.col("cut"), "eval"
    )
    joined = with_dimension(windows, cuts, "lottery_id").withColumn("segment", side)
    return joined.where(F.col("segment").isNotNull())


# --- classifiers -----------------------------------------------------------

FAMILIES = ["random_forest", "extra_trees", "gradient_boosting", "svm"]
FIT_ROWS = 10_000  # labelled training rows a lottery that its models are fitted on, about
BLOCK_ROWS = 16_384  # evaluation rows of a lottery that one task scores, about


def targets_of(baskets: DataFrame) -> DataFrame:
    """Every (lottery, number) that ever occurs: one model each."""
    seen = baskets.select("lottery_id", F.explode("numbers").alias("number"))
    return seen.groupBy("lottery_id", "number").agg(F.lit(1).alias("_one")).drop("_one")


def sequence_models(baskets: DataFrame) -> DataFrame:
    """The fixed target numbers of every lottery."""
    lotteries = baskets.groupBy("lottery_id").agg(F.lit(1).alias("_one"))
    numbers = F.explode(F.array(*[F.lit(n) for n in SEQUENCE_TARGETS]))
    return lotteries.select("lottery_id", numbers.alias("number"))


def next_numbers(baskets: DataFrame) -> DataFrame:
    """The numbers of the draw after each draw; the last draw has none."""
    rows = with_next(baskets.select(*KEY, "numbers")).where(F.col("next_numbers").isNotNull())
    return rows.select(*KEY, "next_numbers")


def training_rows(features: DataFrame, nexts: DataFrame, cuts: DataFrame) -> DataFrame:
    """Feature vector, next numbers and segment of every labelled draw."""
    vector = F.array(*[F.col(c).cast("double") for c in FEATURE_ORDER])
    rows = nexts.join(features, KEY).select(*KEY, "next_numbers", vector.alias("features"))
    return walk_forward_split(rows, cuts).select(*KEY, "segment", "next_numbers", "features")


def sequence_rows(windows: DataFrame, nexts: DataFrame, cuts: DataFrame) -> DataFrame:
    """Flattened window vector, next numbers and segment of every labelled window."""
    split = split_windows(windows, cuts).join(nexts, KEY)
    return split.select(*KEY, "segment", "next_numbers", F.flatten("window").alias("features"))


def matrix(table: pa.Table) -> np.ndarray:
    column = table["features"].combine_chunks()
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit_sample(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """All training rows of a lottery, or about ``fit_rows`` with the lowest hashes where it has more."""
    train = rows.where("segment = 'train'")
    size = train.groupBy("lottery_id").agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64(*KEY), F.lit(1 << 32)) * F.col("_n") < F.lit(fit_rows << 32)
    return with_dimension(train, size, "lottery_id").where((F.col("_n") <= fit_rows) | share)


def fit_models(rows: DataFrame, models: DataFrame, family: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One fitted model per (lottery, number) of ``models``.

    All models of a lottery are fitted on the same training draws: all of them, or about
    ``fit_rows`` with the lowest hashes where a lottery has more.
    """
    sample = fit_sample(rows, fit_rows)
    label = F.array_contains("next_numbers", F.col("number"))
    # A left join: a target whose lottery has no training draw gets its constant model, too.
    labelled = models.select("lottery_id", "number").join(sample, "lottery_id", "left")

    def fitted(key, table):
        known = table.filter(pc.is_valid(table["label"])).sort_by("draw_number")
        y = np.asarray(known["label"]).astype(float)
        model = classifiers.fit(family, matrix(known), y)
        lottery_id, number = (k.as_py() for k in key)
        columns = [pa.array([lottery_id], pa.int32()), pa.array([number], pa.int32()), pa.array([model], pa.binary())]
        return pa.Table.from_arrays(columns, ["lottery_id", "number", "model"])

    wide = labelled.select(*[F.col(c).cast("int").alias(c) for c in ("lottery_id", "number")], "draw_number", label.alias("label"), "features")
    return wide.groupBy("lottery_id", "number").applyInArrow(fitted, "lottery_id int, number int, model binary")


def score_rows(rows: DataFrame, fitted: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Every evaluation row scored by every model of its lottery.

    Evaluation rows are dealt into blocks; a block meets the models of its lottery in one task.
    """
    held_out = rows.where("segment = 'eval'").withColumn("lottery_id", F.col("lottery_id").cast("int"))
    size = held_out.groupBy("lottery_id").agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks"))
    dealt = with_dimension(held_out, size, "lottery_id").select(
        *KEY, "next_numbers", "features", F.pmod(F.xxhash64("draw_number"), "_blocks").alias("block")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    copies = fitted.join(size, "lottery_id").select("lottery_id", "number", "model", every.alias("block"))

    def scored(key, draws, models):
        x, n = matrix(draws), len(draws)
        nexts = draws["next_numbers"].combine_chunks()
        of, flat = np.asarray(pc.list_parent_indices(nexts)), np.asarray(pc.list_flatten(nexts))
        parts = []
        for number, model in zip(models["number"].to_pylist(), models["model"].to_pylist()) if n else []:
            label = np.zeros(n)
            label[of[flat == number]] = 1.0
            score, prediction = classifiers.score(model, x)
            columns = [np.full(n, number, np.int32), label, score, prediction]
            parts.append(pa.Table.from_arrays(
                [draws["lottery_id"], draws["draw_number"], *map(pa.array, columns)], list(SCORED.names)
            ))
        return pa.concat_tables(parts) if parts else SCORED.empty_table()

    keys = ["lottery_id", "block"]
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(
        scored, "lottery_id int, draw_number bigint, number int, label double, score double, prediction double"
    )


def train_family(family: str, rows: DataFrame, models: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Scored evaluation rows of one classifier per (lottery, number) of ``models``."""
    rows = checkpoint_frame(rows)
    fitted = checkpoint_frame(fit_models(rows, models, family, fit_rows))
    return checkpoint_frame(score_rows(rows, fitted))
