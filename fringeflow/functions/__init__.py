"""SQL expressions shared by the operators.

Functions take and return SQL text for ``selectExpr`` and ``expr``: one call
into the JVM per expression, however long it is.
"""
