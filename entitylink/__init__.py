"""Spark jobs that integrate heterogeneous tables and harmonise their names to canonical entities."""
