"""A registry of per-draw features that may build on each other.

A column feature is an expression over ``numbers``, the lottery's rules and the features that it
depends on; expressions without a series between them share one narrow pass. A series feature gets
the frame so far and returns (lottery_id, draw_number, value).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urnframe.operators import features
from urnframe.operators.features import KEY
from urnframe.plans.joins import with_dimension
from urnframe.session import checkpoint_frame


@dataclass(frozen=True)
class Feature:
    build: Callable
    depends_on: tuple[str, ...] = ()
    series: bool = False
    active: bool = True
    looks_ahead: bool = False  # made from later draws: never part of a frame


class Registry:
    """Named features; a feature that would close a cycle is refused and leaves the registry as it was."""

    def __init__(self) -> None:
        self.features: dict[str, Feature] = {}

    def add(self, name: str, build: Callable, depends_on: Iterable[str] = (), **kind: bool) -> None:
        """Register ``build``: ``() -> Column``, or with ``series=True`` ``(frame, lottery) -> DataFrame``."""
        if name in self.features:
            raise ValueError(f"feature {name} exists")
        wanted = {**self.features, name: Feature(build, tuple(depends_on), **kind)}
        try:
            TopologicalSorter({n: f.depends_on for n, f in wanted.items()}).prepare()
        except CycleError as error:
            raise ValueError(f"feature {name} closes a cycle: {' > '.join(error.args[1])}") from None
        self.features = wanted

    def skipped(self) -> dict[str, str]:
        """Features that cannot be built, and why: switched off, looking ahead, or needing such a one."""
        out: dict[str, str] = {}
        for name in TopologicalSorter({n: f.depends_on for n, f in self.features.items()}).static_order():
            feature = self.features.get(name)
            if feature is None:
                out[name] = "unknown"
            elif not feature.active:
                out[name] = "inactive"
            elif feature.looks_ahead:
                out[name] = "looks ahead"
            elif missing := [d for d in feature.depends_on if d in out]:
                out[name] = f"needs {missing[0]}"
        return out

    def order(self, names: Iterable[str] | None = None) -> list[str]:
        """The named features (all by default) and what they need, each behind its dependencies; ties by name."""
        left_out = self.skipped()
        todo = list(names) if names is not None else [n for n in self.features if n not in left_out]
        needed: set[str] = set()
        while todo:
            name = todo.pop()
            if name in left_out or name not in self.features:
                raise ValueError(f"feature {name} cannot be built: {left_out.get(name, 'unknown')}")
            if name not in needed:
                needed.add(name)
                todo += self.features[name].depends_on
        sorter = TopologicalSorter({n: self.features[n].depends_on for n in needed})
        sorter.prepare()
        out: list[str] = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=lambda n: (self.features[n].series, n))
            out += ready
            sorter.done(*ready)
        return out

    def frame(self, baskets: DataFrame, lottery: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """(lottery_id, draw_number, the named features), one row a draw."""
        names = list(names) if names is not None else self.order()
        rules = lottery.select("lottery_id", "min_number", "max_number")
        out = with_dimension(baskets.select(*KEY, "numbers"), rules, "lottery_id")
        for name in self.order(names):
            feature = self.features[name]
            if feature.series:
                out = checkpoint_frame(out)  # read by the series and by the join
                value = feature.build(out, lottery).select(*[F.col(c).alias(c) for c in (*KEY, name)])
                out = out.join(value, KEY, "left")
            else:
                out = out.withColumn(name, feature.build())
        return out.select(*KEY, *names)


def standard() -> Registry:
    """A registry with the features of the matrix."""
    out = Registry()
    for name, build in features.BASKET_FEATURES.items():
        out.add(name, build)
    out.add("repeated_from_previous", lambda frame, lottery: features.repeated_from_previous(frame), series=True)
    out.add("max_current_gap", lambda frame, lottery: features.max_current_gap(frame, lottery), series=True)
    return out


def change_of(name: str, out: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Series feature: the difference of a feature to that of the draw before; null at the first draw."""
    from urnframe.plans.series import running

    def build(frame: DataFrame, lottery: DataFrame) -> DataFrame:
        before = running(
            frame.select(*KEY, name), ["lottery_id"], "draw_number", {"_before": ("last", F.col(name))}, exclusive=True
        )
        return before.select(*KEY, (F.col(name) - F.col("_before")).alias(out))

    return build


def share_of(part: str, whole: str) -> Callable[[], Column]:
    """Column feature: one feature as a share of another; null where that is 0."""
    return lambda: F.when(F.col(whole) != 0, F.col(part) / F.col(whole))
