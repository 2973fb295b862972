"""Registered queries by family; importing a module registers its queries."""

from .common import ORACLES, QUERIES
from . import datasets, detection, replacement, texts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
