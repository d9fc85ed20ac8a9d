"""Queries over the given tables that exercise every operator, with SQL to check them."""
