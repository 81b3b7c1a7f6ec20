"""Further number, draw, position and series statistics, and unsupervised models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.operators.features import FEATURE_ORDER
from urnframe.operators.scan import last_draws
from urnframe.plans.series import dense_index, framed, running
from urnframe.session import checkpoint_frame

KEY = ["lottery_id", "draw_number"]
NUMBER = ["lottery_id", "number"]


def frequency_last(baskets: DataFrame, sizes: Sequence[int] = (10, 25, 50, 100)) -> DataFrame:
    """Counts over the newest draws for several lengths in one pass."""
    slim = baskets.select("lottery_id", "draw_number", "numbers")
    recent = last_draws(slim, max(sizes))
    newest = W.partitionBy("lottery_id").orderBy(F.desc("draw_number"))
    rows = recent.withColumn("_r", F.row_number().over(newest)).select(
        "lottery_id", "_r", F.explode("numbers").alias("number")
    )
    return rows.groupBy(*NUMBER).agg(
        *[F.count_if(F.col("_r") <= n).alias(f"last_{n}") for n in sizes]
    )


def number_state(baskets: DataFrame) -> DataFrame:
    """Age, current gap and longest streak of every number, in draws."""
    indexed = dense_index(
        baskets.select("lottery_id", "draw_number", "numbers"), ["lottery_id"], "draw_number"
    )
    indexed = checkpoint_frame(indexed)
    size = indexed.groupBy("lottery_id").agg(F.max("idx").alias("_last"))
    seen = indexed.select("lottery_id", "idx", F.explode("numbers").alias("number"))
    placed = running(seen, NUMBER, "idx", {"_k": ("sum", F.lit(1).cast("long"))})
    # Consecutive draws share idx - k: one island per streak.
    islands = placed.groupBy(*NUMBER, (F.col("idx") - F.col("_k")).alias("_island")).agg(
        F.count("*").alias("_n"), F.min("idx").alias("_lo"), F.max("idx").alias("_hi")
    )
    per_number = islands.groupBy(*NUMBER).agg(
        F.max("_n").alias("longest_streak"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    return per_number.join(size, "lottery_id").select(
        *NUMBER,
        (F.col("_last") - F.col("_lo")).alias("age"),
        (F.col("_last") - F.col("_hi")).alias("current_gap"),
        "longest_streak",
    )


def _is_prime(n: Column) -> Column:
    divisors = F.sequence(F.lit(2), F.greatest(F.floor(F.sqrt(n)).cast("int"), F.lit(2)))
    return (n == 2) | ((n > 2) & ~F.exists(divisors, lambda d: n % d == 0))


def _is_square(n: Column) -> Column:
    root = F.round(F.sqrt(n)).cast("long")
    return root * root == n


def _is_fibonacci(n: Column) -> Column:
    square = 5 * n.cast("long") * n.cast("long")
    return _is_square(square + 4) | _is_square(square - 4)


def member_counts(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    """How many numbers of a draw are prime, Fibonacci, multiples of 3 and 5, low and high."""
    mid = F.floor((F.col("min_number") + F.col("max_number")) / 2)
    ruled = baskets.select(*KEY, "numbers").join(
        lottery.select("lottery_id", "min_number", "max_number"), "lottery_id"
    )

    def count(test) -> Column:
        return F.size(F.filter("numbers", test)).cast("long")

    return ruled.select(
        *KEY,
        count(_is_prime).alias("prime_count"),
        count(_is_fibonacci).alias("fibonacci_count"),
        count(lambda x: x % 3 == 0).alias("multiples_of_3"),
        count(lambda x: x % 5 == 0).alias("multiples_of_5"),
        count(lambda x: x <= mid).alias("low_count"),
        count(lambda x: x > mid).alias("high_count"),
    )


def draw_shape(baskets: DataFrame) -> DataFrame:
    """Median, mode, variance, deviation, skewness, kurtosis, entropy of the numbers of a draw.

    Population moments. The numbers of a draw are distinct, so the mode is the lowest number
    and the entropy log2 of their count.
    """
    n = F.size("numbers")

    def moment(power: int) -> Column:
        parts = F.transform("numbers", lambda x: F.pow(x - F.col("_mean"), F.lit(float(power))))
        return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) / n

    total = F.aggregate("numbers", F.lit(0.0), lambda acc, x: acc + x)
    first = baskets.select(*KEY, F.sort_array("numbers").alias("numbers"), (total / n).alias("_mean"))
    middle = F.when(
        n % 2 == 1, F.element_at("numbers", ((n + 1) / 2).cast("int")).cast("double")
    ).otherwise(
        (F.element_at("numbers", (n / 2).cast("int")) + F.element_at("numbers", (n / 2).cast("int") + 1))
        / 2
    )
    shaped = first.select(
        *KEY,
        middle.alias("median"),
        F.array_min("numbers").alias("mode"),
        moment(2).alias("variance"),
        moment(3).alias("_m3"),
        moment(4).alias("_m4"),
        F.log2(n.cast("double")).alias("entropy"),
    )
    flat = F.col("variance") == 0
    return shaped.select(
        *KEY,
        "median",
        "mode",
        "variance",
        F.sqrt("variance").alias("stddev"),
        F.when(flat, F.lit(0.0)).otherwise(F.col("_m3") / F.pow("variance", F.lit(1.5))).alias("skewness"),
        F.when(flat, F.lit(0.0)).otherwise(F.col("_m4") / F.pow("variance", F.lit(2.0)) - 3).alias("kurtosis"),
        "entropy",
    )


def position_stats(baskets: DataFrame) -> DataFrame:
    """Mean, deviation, trend (slope over the draw ordinal) and entropy per position."""
    indexed = dense_index(
        baskets.select("lottery_id", "draw_number", "numbers"), ["lottery_id"], "draw_number"
    )
    rows = indexed.select("lottery_id", "idx", F.posexplode("numbers").alias("pos", "number"))
    by = ["lottery_id", "pos"]
    moments = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("number").alias("mean"),
        F.stddev_pop("number").alias("stddev"),
        F.regr_slope(F.col("number").cast("double"), F.col("idx").cast("double")).alias("trend"),
    )
    counts = rows.groupBy(*by, "number").agg(F.count("*").alias("_c"))
    share = F.col("_c") / F.sum("_c").over(W.partitionBy(*by))  # at most the universe per group
    entropy = counts.withColumn("_p", share).groupBy(*by).agg(
        F.sum(-F.col("_p") * F.log2("_p")).alias("entropy")
    )
    return moments.join(entropy, by).select(
        "lottery_id", (F.col("pos") + 1).alias("position"), "n", "mean", "stddev", "trend", "entropy"
    )


def number_differences(baskets: DataFrame) -> DataFrame:
    """Differences between neighbours of the sorted draw, and the distance to its lowest number."""
    s = F.sort_array("numbers")
    n = F.size("numbers")
    steps = F.zip_with(
        F.slice(s, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(s, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct((b - a).alias("difference"), (b - s[0]).alias("distance")),
    )
    return baskets.select(*KEY, F.posexplode(steps).alias("_p", "s")).select(
        *KEY, (F.col("_p") + 1).alias("step"), "s.difference", "s.distance"
    )


def series_indicators(values: DataFrame, value: str, width: int = 10, decay: float = 0.2) -> DataFrame:
    """Moving mean, weighted mean, momentum, slope, acceleration and volatility of a series.

    ``values`` has one row per draw. Every frame holds ``width`` rows; rows without a full
    frame are left out. The exponential mean is cut to the frame and its weights rescaled.
    """
    indexed = dense_index(values.select(*KEY, value), ["lottery_id"], "draw_number")
    weights = [decay * (1 - decay) ** k for k in range(width)]
    total = sum(weights)

    def build(window):
        frame = window.rowsBetween(-(width - 1), 0)
        x = F.col(value)
        ema = F.lit(0.0)
        for k, w in enumerate(weights):
            ema = ema + F.coalesce(F.lag(x, k).over(window), F.lit(0)) * (w / total)
        return {
            "_n": F.count("*").over(frame),
            "sma": F.avg(x).over(frame),
            "ema": ema,
            "momentum": x - F.lag(x, width - 1).over(window),
            "slope": F.regr_slope(x.cast("double"), F.col("idx").cast("double")).over(frame),
            "acceleration": x - 2 * F.lag(x, 1).over(window) + F.lag(x, 2).over(window),
            "volatility": F.stddev_pop(x).over(frame),
        }

    out = framed(indexed, ["lottery_id"], "idx", width - 1, build)
    names = ["sma", "ema", "momentum", "slope", "acceleration", "volatility"]
    return out.where(F.col("_n") == width).select(*KEY, *names)


def probability_bounds(empirical: DataFrame, scope: DataFrame, z: float = 1.96) -> DataFrame:
    """Cumulative probability in number order and a normal interval around each share."""
    p, n = F.col("value"), F.col("draw_count")
    order = W.partitionBy("lottery_id").orderBy("number")  # at most the universe per lottery
    half = F.lit(z) * F.sqrt(p * (1 - p) / n)
    joined = empirical.join(scope.select("lottery_id", "draw_count"), "lottery_id")
    return joined.select(
        "lottery_id",
        "number",
        p.alias("probability"),
        F.sum(p).over(order).alias("cumulative"),
        F.greatest(p - half, F.lit(0.0)).alias("low"),
        F.least(p + half, F.lit(1.0)).alias("high"),
    )


def frequent_itemsets(baskets: DataFrame, support: float) -> DataFrame:
    """Sets of numbers that at least a share of ``support`` of their own lottery's draws hold.

    lottery_id, items (rising), freq. Level by level: a draw carries its frequent sets of the level
    before and extends each by its larger numbers, so every lottery keeps its own least count and a
    small lottery never lowers that of a hot one. Counts combine before the shuffle.
    """
    sizes = baskets.groupBy("lottery_id").agg(F.count("*").alias("_n"))
    scope = checkpoint_frame(sizes.select("lottery_id", F.ceil(F.lit(support) * F.col("_n")).alias("_least")))
    start = baskets.select(*KEY, F.explode(F.array_distinct("numbers")).alias("x")).where("x is not null")
    long = start.select(*KEY, F.array("x").alias("items"))
    found = None
    size = 1
    while True:
        counted = long.groupBy("lottery_id", "items").agg(F.count("*").alias("freq"))
        level = checkpoint_frame(counted.join(scope, "lottery_id").where("freq >= _least").drop("_least"))
        if level.isEmpty():
            return level if found is None else found
        found = level if found is None else found.unionByName(level)
        kept = long.join(level.select("lottery_id", "items"), ["lottery_id", "items"], "left_semi")
        own = kept.groupBy(*KEY).agg(F.collect_list("items").alias("_sets"))
        # a set of the next level has all its parts among the frequent sets of the draw
        numbers = F.sort_array(F.array_distinct(F.flatten("_sets")))
        own = own.where(F.size("_sets") > size).select(*KEY, "_sets", numbers.alias("_numbers"))
        larger = lambda s: F.filter("_numbers", lambda x: x > F.element_at(s, -1))
        grown = F.flatten(F.transform("_sets", lambda s: F.transform(larger(s), lambda x: F.concat(s, F.array(x)))))
        long = checkpoint_frame(own.select(*KEY, F.explode(grown).alias("items")))
        size += 1


def association_rules(baskets: DataFrame, sets: DataFrame, confidence: float = 0.1) -> DataFrame:
    """Rules with one consequent from the frequent sets; support and lift within the rule's lottery."""
    n = baskets.groupBy("lottery_id").agg(F.count("*").alias("_n"))
    rest = lambda c: F.filter("items", lambda x: x != c)
    whole = sets.where(F.size("items") > 1).select("lottery_id", "items", "freq", F.explode("items").alias("consequent"))
    split = whole.select("lottery_id", rest(F.col("consequent")).alias("antecedent"), "consequent", "freq")
    before = sets.select("lottery_id", F.col("items").alias("antecedent"), F.col("freq").alias("_a"))
    alone = sets.where(F.size("items") == 1).select("lottery_id", F.col("items")[0].alias("consequent"), F.col("freq").alias("_c"))
    joined = split.join(before, ["lottery_id", "antecedent"]).join(alone, ["lottery_id", "consequent"]).join(n, "lottery_id")
    sure = F.col("freq") / F.col("_a")
    return joined.where(sure >= confidence).select(
        "lottery_id", "antecedent", "consequent", sure.alias("confidence"),
        (sure * F.col("_n") / F.col("_c")).alias("lift"), (F.col("freq") / F.col("_n")).alias("support"),
    )


def kmeans_draws(features: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """Cluster of every draw on standardised features."""
    vector = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="_raw").transform(features)
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(vector).transform(vector)
    model = KMeans(k=k, seed=seed).fit(scaled)
    return model.transform(scaled).select(*KEY, F.col("prediction").alias("cluster"))


def pca_features(features: DataFrame, k: int = 3) -> DataFrame:
    """Variance share of the first ``k`` principal components of the standardised features."""
    vector = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="_raw").transform(features)
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(vector).transform(vector)
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(scaled)
    parts = vector_to_array("pca")
    return model.transform(scaled).select(*KEY, *[parts[i].alias(f"pc{i + 1}") for i in range(k)])


def label_cells(draws: DataFrame, seen: DataFrame, feature: str) -> DataFrame:
    """How many draws hold each (lottery_id, number, feature value, label), as ``n``.

    ``draws`` has the feature and ``next_numbers`` of every labelled draw. Draws are counted by value and
    hits by value and number; what is left of a value's draws has label 0. So no draw meets the
    universe and no table of draws is joined.
    """
    value = ["lottery_id", feature]
    sizes = draws.groupBy(*value).agg(F.count("*").alias("_n"))
    hits = draws.select(*value, F.explode(F.array_distinct("next_numbers")).alias("number")).groupBy(*value, "number").agg(
        F.count("*").alias("_hits")
    )
    every = sizes.join(seen.select("lottery_id", "number"), "lottery_id").join(hits, [*value, "number"], "left")
    hit = F.coalesce("_hits", F.lit(0))
    both = F.array(
        F.struct(F.lit(1).alias("label"), hit.alias("n")), F.struct(F.lit(0).alias("label"), (F.col("_n") - hit).alias("n"))
    )
    return every.select(*value, "number", F.explode(both).alias("c")).select(*value, "number", "c.*").where("n > 0")


def mutual_information(rows: DataFrame, feature: str, label: str = "label", weight: str | None = None) -> DataFrame:
    """Mutual information in bits of a discrete feature and the label, per number.

    A row counts ``weight`` times, or once.
    """
    by = ["lottery_id", "number"]
    times = F.sum(weight) if weight else F.count("*")
    cells = checkpoint_frame(rows.groupBy(*by, feature, label).agg(times.cast("double").alias("_xy")))
    x = cells.groupBy(*by, feature).agg(F.sum("_xy").alias("_x"))
    y = cells.groupBy(*by, label).agg(F.sum("_xy").alias("_y"))
    n = cells.groupBy(*by).agg(F.sum("_xy").alias("_n"))
    joined = cells.join(x, [*by, feature]).join(y, [*by, label]).join(n, by)
    part = F.col("_xy") / F.col("_n") * F.log2(F.col("_xy") * F.col("_n") / (F.col("_x") * F.col("_y")))
    return joined.groupBy(*by).agg(F.sum(part).alias("bits"))


def lasso_rows(features: DataFrame, nexts: DataFrame, models: DataFrame) -> DataFrame:
    """The labels of all ``models`` of every draw as two weighted rows, one a class.

    The features of a draw are the same for every number, so the weights stand for the rows.
    """
    sizes = models.groupBy("lottery_id").agg(F.count("*").alias("_all"), F.collect_list("number").alias("_known"))
    hits = F.size(F.array_intersect("next_numbers", "_known"))
    rows = nexts.join(features, KEY).join(sizes, "lottery_id")
    classes = F.array(
        F.struct(F.lit(1.0).alias("label"), hits.cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("_all") - hits).cast("double").alias("weight")),
    )
    return rows.select(*FEATURE_ORDER, F.explode(classes).alias("c")).select(*FEATURE_ORDER, "c.*").where("weight > 0")


def lasso_selection(rows: DataFrame, strength: float = 0.01) -> DataFrame:
    """Weight of every feature in an L1 logistic model of the labels; 0 means dropped."""
    vector = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="features").transform(rows)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=strength, standardization=True, weightCol="weight")
    model = lasso.fit(vector.select("features", "label", "weight"))
    pairs = list(zip(FEATURE_ORDER, [float(w) for w in model.coefficients]))
    return rows.sparkSession.createDataFrame(pairs, "feature_id string, weight double")
