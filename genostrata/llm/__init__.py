"""Training-data operators: one module per operator, queries registered in ``queries``.

Nothing outside this subpackage imports it; the rest of the library works without it.
"""
