"""Readers: bytes to document rows."""
