"""Named queries over the test tables."""

import importlib

MODULES = ("tape", "bar_queries", "structure_queries", "signal_queries", "stat_queries", "filter_queries", "feature_queries", "source_queries", "store_queries")


def all_queries():
    from . import registry
    for m in MODULES:
        try:
            importlib.import_module(f".{m}", __name__)
        except ModuleNotFoundError as e:
            if m not in str(e):
                raise
    return registry.QUERIES, registry.SQL
