"""Queries that apply the operators to tables, each with its SQL twin."""
