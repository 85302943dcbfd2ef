"""Column functions: every one is ``f(col...) -> Column``."""
