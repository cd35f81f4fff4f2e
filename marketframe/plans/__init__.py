"""Derived tables, refreshes and registered queries."""
