"""All registered queries; importing the package fills the registry."""

import importlib

from broadloom.queries.registry import ORACLES, QUERIES

SECTIONS = (
    "matrix_queries",
    "scaler_queries",
    "stats_queries",
    "trial_queries",
    "model_queries",
    "compat_queries",
)

for _section in SECTIONS:
    importlib.import_module(f"broadloom.queries.{_section}")

__all__ = ["ORACLES", "QUERIES"]
