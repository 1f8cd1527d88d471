"""Queries bound to the driver's tables."""

from . import domain, files, relational, workflow  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
