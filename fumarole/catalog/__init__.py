"""The query catalog: every operator over the driver tables, with SQL to check it."""

from types import ModuleType


def load() -> ModuleType:
    """The registry with all query modules imported."""
    from fumarole.catalog import analysis, models, registry, tables  # noqa: F401

    return registry
