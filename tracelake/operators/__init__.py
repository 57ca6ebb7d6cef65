"""Relational operators over trace tables and position fixes."""
