"""Registered queries: each operator on the given tables, with its SQL twin."""

from __future__ import annotations

_PARTS = ["standins", "scalars", "filters", "aggregates", "joins", "windows", "domain",
          "sources", "sinks", "streams"]


def registered() -> tuple[dict, dict]:
    import importlib

    from suite import base
    for part in _PARTS:
        importlib.import_module(f"suite.{part}")
    return dict(base.QUERIES), dict(base.ORACLES)
