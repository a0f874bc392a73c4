"""Training-data pipeline operators.

Nothing outside this subpackage imports it; each operator lives in a module of
its own and ``queries`` registers the digest query of each.
"""
