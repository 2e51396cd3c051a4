"""CRM analytics as plain Spark DataFrame jobs.

Layers: raw entity tables -> processed tables (row-wise features) -> summaries
(one pass per entity for all its aggregates) -> aggregated tables -> chart datasets,
KPI row and dashboard document.
"""
