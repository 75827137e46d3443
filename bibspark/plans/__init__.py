"""Test views over the given tables, registered queries and their SQL twins."""
