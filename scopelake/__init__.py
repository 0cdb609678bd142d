"""Scoped, change-log-driven relational data on Spark."""
