"""Column to Column."""
