"""Registered queries and their SQL twins, one module a family."""
