"""tambo: market price survey analytics expressed as Spark DataFrame plans.

Layers
------
sources/    survey CSV scans, derived fixtures, warehouse and history reads
functions/  column expressions (parsing, calendar, formatting, renames)
operators/  validation, unpivot, filters, metrics, forecasts, scale sales
plans/      warehouse load (dimensions, facts, semantic view) and the
            distributed ordinal index used by raw-row regressions
streaming/  scale sales fed continuously through foreachBatch
"""

__all__ = ["session"]
