"""Relational operators over scoped tables and change logs."""
