"""Operators: every one is ``f(df..., params) -> DataFrame``."""
