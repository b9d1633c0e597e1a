"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from linkwright.llm import queries_free, queries_native

QUERIES = {**queries_native.QUERIES, **queries_free.QUERIES}
ORACLES = queries_native.ORACLES | queries_free.ORACLES
