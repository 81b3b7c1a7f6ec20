"""Every registered job with its SQL twin, grouped by topic."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "statistics",
    "features",
    "ingestion",
    "probability",
    "graphs",
    "training",
    "backtesting",
    "models",
    "texts",
    "streams",
]


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
