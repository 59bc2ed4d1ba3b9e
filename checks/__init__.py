"""Registered queries: each Spark query beside the SQL that states its result."""
