"""All queries and oracles, gathered from the plan modules."""

from __future__ import annotations

from lodestone.plans import access, aggregates, currentness, documents, evaluation, fact_coverage, grounding, guards, jobs, layout, ledger_sources, ledgers, lineage, pages, pickers, predicates, readings, relational, replacement, requirement_tables, retrieval, scans, scoring, search, sessions, stateful, text, validation
from lodestone.plans.registry import ORACLES, QUERIES

MODULES = (access, aggregates, currentness, documents, evaluation, fact_coverage, grounding, guards, jobs, layout, ledger_sources, ledgers, lineage, pages, pickers, predicates, readings, relational, replacement, requirement_tables, retrieval, scans, scoring, search, sessions, stateful, text, validation)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
