"""Training-data operators: one module an operator, and ``queries`` with what the driver runs.

Nothing outside this subpackage imports it.
"""
