"""Operators of a training-data pipeline: filters, joins, searches, tokens.

Nothing outside this subpackage imports it; ``tickloom.llm.queries`` holds its
registered queries and their SQL.
"""
