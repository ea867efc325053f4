"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = [
    "host_rules",
    "url_model",
    "pseudonyms",
    "quality_fm",
    "toxicity",
    "byte_lm",
    "language_id",
    "packing",
    "tiling",
    "jaccard_join",
    "merkle",
    "curriculum",
    "lexical",
]


def _merge(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"{__package__}.{m}"), attr))
    return out


def all_queries() -> dict:
    return _merge("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merge("ORACLES")
