"""Training-data operators: one module for each, queries in ``queries.py``.

Nothing outside this subpackage imports it.
"""
