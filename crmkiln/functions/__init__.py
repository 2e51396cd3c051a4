"""SQL expressions shared by all operators.

Expressions are built as Spark SQL text and handed to ``selectExpr`` and ``agg`` in one piece: the
plans equal those of Column objects, but a query is declared with a handful of calls into the JVM
instead of thousands.
"""
