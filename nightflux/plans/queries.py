"""All registered queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import classes, colors, files, light_curves, models, records, selection, served, warpsets  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
