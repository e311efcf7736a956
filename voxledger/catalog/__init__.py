"""Queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ("scan", "prepare", "indicators", "spectra", "profiles", "compare", "evaluate", "sources", "reports", "streams")


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"voxledger.catalog.{name}")
    return importlib.import_module("voxledger.catalog.registry")
