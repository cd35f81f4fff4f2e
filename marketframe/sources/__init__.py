"""Reading and writing keyed tables."""
