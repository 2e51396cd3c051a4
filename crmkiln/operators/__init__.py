"""Features, aggregates, KPIs, charts, derived measures and quality checks."""
