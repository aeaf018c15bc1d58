"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ("panel", "aggregates", "joins", "sessions", "text", "outcomes", "eventstudy", "stats", "storage", "models")

for _m in MODULES:
    importlib.import_module(f"bellwether.plans.{_m}")

from bellwether.plans.registry import CATALOGUE, run  # noqa: E402,F401
