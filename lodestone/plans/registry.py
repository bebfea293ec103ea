"""All queries of the evidence engine, and their SQL, by name."""

from __future__ import annotations

from lodestone.plans import admission_queries, control_queries, evidence_queries, lead_queries, ledger_queries, module_queries, portfolio_queries, provenance_queries, research_queries, text_queries

FLAGSHIP = "search_distinct"
_PARTS = (text_queries, ledger_queries, evidence_queries, module_queries, lead_queries, admission_queries, control_queries, provenance_queries, research_queries, portfolio_queries)
QUERIES: dict = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in _PARTS for k, v in m.SQL.items()}
