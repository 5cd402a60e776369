"""Registered queries over the operators."""

from __future__ import annotations

import importlib

MODULES = ("q_detections", "q_metrics", "q_evalset", "q_scripts", "q_pages", "q_masks", "q_sources", "q_files")


def registered() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all modules."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    from .registry import ORACLE_SQL, QUERIES

    return dict(QUERIES), dict(ORACLE_SQL)
