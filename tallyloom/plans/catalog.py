"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["usage", "advice", "scan", "docs", "effort", "tasks", "store"]


def _merge(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(importlib.import_module(f"{__package__}.{m}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merge("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merge("ORACLES")
