"""Queries over the test tables, by area; load_all() registers them."""

from importlib import import_module

AREAS = ("lanes", "texts", "cases", "feeds", "probes", "verdicts", "laws", "fits", "synthesis", "runs", "typed", "pairs", "decisions")


def load_all() -> None:
    for area in AREAS:
        import_module(f"graywether.plans.{area}")
