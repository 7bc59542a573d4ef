"""Registered queries, family by family."""
