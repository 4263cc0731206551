"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from veilspark.plans import queries_detect, queries_redact, queries_store

QUERIES = {**queries_detect.QUERIES, **queries_redact.QUERIES, **queries_store.QUERIES}
ORACLES = {**queries_detect.ORACLES, **queries_redact.ORACLES, **queries_store.ORACLES}
