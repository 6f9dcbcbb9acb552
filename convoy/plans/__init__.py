"""Registered queries: library operators over the given tables, with equal SQL where it exists."""

from importlib import import_module

MODULES = ["telemetry", "quality", "features", "fleet", "geo", "search", "streams", "ml", "stores"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"convoy.plans.{name}")
