"""Registered queries: a Spark plan and, where SQL can say the same, its oracle."""
