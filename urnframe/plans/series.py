"""Ordered scans over one long series without putting the series into one task.

A plain ``Window.partitionBy("lottery_id")`` sorts a whole lottery in a single task. Here an
integer order key is cut into chunks of ``2**bits`` values. Rows are scanned inside their
chunk, each chunk is reduced to one summary row, the summaries are scanned, and the carry of
the earlier chunks is added back by an equi-join on (series, chunk). The order key is unique
in its series, so a chunk holds at most ``2**bits`` rows whatever the skew between series.
The summaries are ``2**bits`` times fewer than the key span; ``levels`` repeats the cut on
them when that is still too many.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_BITS = 16

Spec = tuple[str, Column]  # (sum | min | max | last, value)


def _over(fn: str, value: Column) -> Column:
    if fn == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[fn](value)


def _merge(fn: str, carry: Column, local: Column) -> Column:
    if fn == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if fn == "min":
        return F.least(carry, local)
    if fn == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry)


def _scan(df: DataFrame, part: Sequence[str], order: str, specs, exclusive: bool) -> DataFrame:
    frame = W.partitionBy(*part).orderBy(order)
    frame = frame.rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    return df.select("*", *[_over(fn, v).over(frame).alias(out) for out, (fn, v) in specs.items()])


def running(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    specs: Mapping[str, Spec],
    *,
    exclusive: bool = False,
    bits: int = CHUNK_BITS,
    levels: int = 1,
) -> DataFrame:
    """Add running aggregates over each series, ordered by the integer column ``order``.

    ``specs`` maps an output name to (function, value). ``last`` is the last non-null value.
    ``exclusive`` leaves the current row out, so ``("last", x)`` is "x as of the row before".
    """
    part = list(part)
    if levels == 0:
        return _scan(df, part, order, specs, exclusive)
    chunk = f"_c{levels}"
    keyed = df.withColumn(chunk, F.shiftright(F.col(order).cast("long"), bits))
    local = _scan(keyed, [*part, chunk], order, specs, exclusive)

    def whole(fn: str, value: Column) -> Column:
        if fn == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
        return _over(fn, value)

    summary = keyed.groupBy(*part, chunk).agg(
        *[whole(fn, v).alias(f"_w_{out}") for out, (fn, v) in specs.items()]
    )
    carried = running(
        summary,
        part,
        chunk,
        {f"_b_{out}": (fn, F.col(f"_w_{out}")) for out, (fn, _) in specs.items()},
        exclusive=True,
        bits=bits,
        levels=levels - 1,
    ).select(*part, chunk, *[f"_b_{out}" for out in specs])
    joined = local.join(carried, [*part, chunk])
    merged = {out: _merge(fn, F.col(f"_b_{out}"), F.col(out)) for out, (fn, _) in specs.items()}
    return joined.select(*[c for c in df.columns], *[m.alias(out) for out, m in merged.items()])


def dense_index(df: DataFrame, part: Sequence[str], order: str, out: str = "idx", **kw) -> DataFrame:
    """0-based ordinal of every row in its series."""
    return running(df, part, order, {out: ("sum", F.lit(1).cast("long"))}, exclusive=True, **kw)


def framed(
    df: DataFrame,
    part: Sequence[str],
    idx: str,
    before: int,
    build,
    *,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Evaluate window columns that look at most ``before`` rows back.

    ``idx`` is a dense index. The last ``before`` rows of a chunk are copied into the next one,
    so each chunk sees its whole frame; the copies are dropped afterwards. ``build`` gets the
    window (partitioned and ordered, no frame) and returns {name: column}.
    """
    size = 1 << bits
    if not 0 <= before <= size:
        raise ValueError(f"a frame of {before} rows does not fit a chunk of {size}")
    home = F.shiftright(F.col(idx).cast("long"), bits)
    tail = F.col(idx) % size >= size - before
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_chunk", F.explode(copies))
    window = W.partitionBy(*part, "_chunk").orderBy(idx)
    columns = build(window)
    return (
        spread.select("*", *[c.alias(name) for name, c in columns.items()])
        .where(F.col("_chunk") == home)
        .drop("_chunk")
    )


def total_rank(
    df: DataFrame, part: Sequence[str], key: str, tie: str, out: str = "rank", **kw
) -> DataFrame:
    """1-based rank by the integer ``key``, equal keys ordered by the unique integer ``tie``.

    Rows ahead are those with a lower key, from a running count over the distinct keys, plus
    those before the row in its own key.
    """
    part = list(part)
    sizes = df.groupBy(*part, key).agg(F.count("*").alias("_n"))
    below = running(sizes, part, key, {"_below": ("sum", F.col("_n"))}, exclusive=True, **kw)
    placed = running(df, [*part, key], tie, {"_in": ("sum", F.lit(1).cast("long"))}, **kw)
    joined = placed.join(below.select(*part, key, "_below"), [*part, key])
    return joined.select(*df.columns, (F.col("_below") + F.col("_in")).alias(out))
