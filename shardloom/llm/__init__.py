"""Training-data operators: one module per operator, thin contract queries in ``queries``.

Nothing outside this subpackage imports it.
"""
