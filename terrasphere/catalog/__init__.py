"""Named queries over the driver's tables, one or more per operator."""

from __future__ import annotations

import importlib

from terrasphere.catalog.base import ORACLE, QUERIES

MODULES = ["geo", "grid", "raster", "pyramid", "coverage", "lines", "palettes", "sources", "terrain", "fault", "views", "streams"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"terrasphere.catalog.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
