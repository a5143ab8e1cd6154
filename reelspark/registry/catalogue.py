"""Loads every registry module."""

from __future__ import annotations

import importlib

from reelspark.registry import common

MODULES = (
    "ingest_queries",
    "explore_queries",
    "feature_queries",
    "profile_queries",
    "compare_queries",
    "model_queries",
    "evaluation_queries",
    "two_tower_queries",
)


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"reelspark.registry.{name}")
    return common.QUERIES, common.ORACLES
