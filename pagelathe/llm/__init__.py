"""Operators for building training corpora: ten of them, each with one registered query.

Nothing outside this folder imports it.
"""
