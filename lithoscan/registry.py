"""Queries by name, each with the SQL that it is checked against where SQL can express it."""

from .operators import device_queries, drc_queries, evidence_queries, flow_queries, lvs_queries, polygon_queries, signoff_queries

MODULES = (drc_queries, polygon_queries, lvs_queries, device_queries, signoff_queries, evidence_queries, flow_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
