"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from . import assurance, evidence, governance, operations, reconstruction

_PARTS = (evidence, reconstruction, governance, assurance, operations)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
