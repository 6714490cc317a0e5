"""Queries built from the operators, each next to the SQL that states its result."""
