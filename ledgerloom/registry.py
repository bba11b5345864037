"""Queries of the ledger operators and their SQL."""

from __future__ import annotations

from .functions import metrics
from .operators import answers, archive, backfill, blocks, contiguity, entities, publish, sessions, state, subscribe
from .streaming import jobs

_MODULES = [answers, blocks, contiguity, archive, publish, sessions, subscribe, state, entities, backfill, metrics, jobs]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.SQL.items()}
