"""The registered queries of the library and their SQL twins."""

from __future__ import annotations

from pagelode.plans import audit_queries, document_queries, domain_queries, evidence_queries, output_queries, part_queries, platform_queries, profile_queries, report_queries, rule_queries, seo_queries, similar_queries, site_queries, structure_queries, vitals_queries

_MODULES = (site_queries, document_queries, rule_queries, vitals_queries, output_queries, domain_queries, profile_queries, audit_queries, seo_queries, similar_queries, structure_queries, evidence_queries, part_queries, report_queries, platform_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
