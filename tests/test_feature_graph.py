"""Features that depend on each other: order, cycles, what is left out, values."""

import pytest
from pyspark.sql import functions as F

from urnframe.operators import feature_graph as graph


def test_order_and_cycles():
    own = graph.Registry()
    own.add("c", lambda: F.col("a") + F.col("b"), ["a", "b"])
    own.add("a", lambda: F.lit(1), ["z"])
    own.add("b", lambda: F.lit(2))
    assert own.skipped() == {"z": "unknown", "a": "needs z", "c": "needs a"}
    own.add("z", lambda: F.lit(0))
    assert own.order() == ["b", "z", "a", "c"] and own.order(["a"]) == ["z", "a"]
    with pytest.raises(ValueError, match="cycle"):
        own.add("y", lambda: F.lit(0), ["y"])
    own.add("u", lambda: F.lit(0), ["v"])
    before = dict(own.features)
    with pytest.raises(ValueError, match="cycle"):
        own.add("v", lambda: F.lit(0), ["u"])
    assert own.features == before
    with pytest.raises(ValueError, match="exists"):
        own.add("a", lambda: F.lit(0))


def test_features_that_look_ahead_are_left_out():
    own = graph.standard()
    own.add("next_sum", lambda: F.lit(0), looks_ahead=True)
    own.add("off", lambda: F.lit(0), active=False)
    own.add("both", lambda: F.lit(0), ["next_sum", "draw_sum"])
    assert own.skipped() == {"next_sum": "looks ahead", "off": "inactive", "both": "needs next_sum"}
    assert not {"next_sum", "off", "both"} & set(own.order())
    with pytest.raises(ValueError, match="both"):
        own.order(["both"])


def test_values(baskets_of, rules_of):
    baskets = baskets_of((1, [1, 2, 3]), (5, [4, 10]), (9, [7, 7]))
    own = graph.standard()
    own.add("share", graph.share_of("change", "draw_range"), ["change", "draw_range"])
    own.add("change", graph.change_of("draw_sum", "change"), ["draw_sum"], series=True)
    got = own.frame(baskets, rules_of(), ["share", "change", "max_current_gap"]).orderBy("draw_number").collect()
    assert [(r.draw_number, r.share, r.change) for r in got] == [(1, None, None), (5, 8 / 6, 8), (9, None, 0)]
    assert all(r.max_current_gap is not None for r in got)
    assert own.frame(baskets, rules_of()).columns == ["lottery_id", "draw_number", *own.order()]
