"""Registered queries, a module a family."""
