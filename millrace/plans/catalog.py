"""Every query over the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from millrace.plans import accounts, audits, gates, lines, lookups, paths, rewrites, sequences, shapes, texts
from millrace.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "accounts", "audits", "gates", "lines", "lookups", "paths", "rewrites", "sequences", "shapes", "texts"]
