"""The package's operators as named queries over the generic test tables."""

from importlib import import_module

MODULES = (
    "read", "sync", "crawl", "items", "costs", "log", "scores", "talk", "rules", "values", "streams",
)


def load() -> None:
    for module in MODULES:
        import_module(f"vernissage.catalog.{module}")
