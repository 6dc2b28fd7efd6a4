"""Retail demand and replenishment analytics as PySpark DataFrame functions."""

from .config import COMPACT_FOREST, DEFAULT_WINDOW, DEMO_WINDOW, ForestParams, StockPolicy, WindowSpec

__all__ = [
    "COMPACT_FOREST",
    "DEFAULT_WINDOW",
    "DEMO_WINDOW",
    "ForestParams",
    "StockPolicy",
    "WindowSpec",
]
