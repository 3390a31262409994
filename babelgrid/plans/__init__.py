"""Named queries (one per inventory operator) and their SQL twins."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

_MODULES = ["q_classification", "q_text", "q_qa", "q_ner", "q_features", "q_sampling", "q_io"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")


load_all()

__all__ = ["QUERIES", "ORACLE", "load_all"]
