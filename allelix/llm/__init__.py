"""Operators for large training corpora: each one is a Spark job over a documents-like table.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only when it is there.
"""
