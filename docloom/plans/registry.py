"""All queries over the reference operators, with their SQL."""

from __future__ import annotations

from . import queries_documents, queries_primitives

QUERIES: dict = {**queries_primitives.QUERIES, **queries_documents.QUERIES}
ORACLES: dict = {**queries_primitives.ORACLES, **queries_documents.ORACLES}
