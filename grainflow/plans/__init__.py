"""Whole analyses and the queries that apply them."""
