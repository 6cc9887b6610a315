"""Every query of the engine by name, with its SQL counterpart."""

from __future__ import annotations

from folioworks.plans import colour_queries, finding_queries, fix_queries, lifecycle_queries, page_queries, pdf_queries, record_queries, report_queries, text_queries, tree_queries, word_queries

MODULES = (colour_queries, text_queries, finding_queries, page_queries, lifecycle_queries, word_queries, fix_queries, pdf_queries, tree_queries, record_queries, report_queries)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
FLAGSHIP = "assess_all"
