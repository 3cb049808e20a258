"""Registered queries: operators composed over the fixture views, with their DuckDB oracles."""

from importlib import import_module

MODULES = ["reads", "tracts", "recoord", "profiles", "population", "cohort", "coverage", "genotypes", "families", "denovo", "statistics", "annotations", "export", "fitted", "text_io", "planted"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
