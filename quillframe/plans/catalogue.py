"""All queries of the engine but those of the subpackage on training data."""

from __future__ import annotations

from quillframe.plans import curated, fidelity, markdown, relational, retrieval, streams, text_graph

_PARTS = (relational, retrieval, text_graph, streams, curated, fidelity, markdown)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
