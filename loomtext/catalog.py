"""Every query by name, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from .plans import q_graph, q_ops, q_segment, q_style

_MODULES = (q_style, q_segment, q_graph, q_ops)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
