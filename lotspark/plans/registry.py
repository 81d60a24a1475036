"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("q_scalars", "q_rights", "q_comparables", "q_trades", "q_search")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"lotspark.plans.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
