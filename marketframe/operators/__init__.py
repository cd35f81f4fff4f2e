"""Relational operators over market tables."""
