"""Queries over the test tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("sources", "reshape", "aggregates", "evaluation", "scalars", "diagnostics", "models", "learners")


def load_all() -> None:
    """Import every module so that its queries register."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
