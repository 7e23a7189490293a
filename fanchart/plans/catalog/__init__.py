"""Registered queries, one module per operator family."""

from importlib import import_module

MODULES = ("sources", "panel", "generators", "gates", "metrics", "aggregate", "corpus")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
