"""Importing this module registers every query."""

import importlib

from .catalog import ORACLES, QUERIES  # noqa: F401

MODULES = ["q_prices", "q_filings", "q_stats", "q_app", "q_text", "q_models", "q_studies"]
for _m in MODULES:
    importlib.import_module(f"pitspark.plans.{_m}")
