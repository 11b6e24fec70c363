"""Operators over node and edge tables beyond the query language."""
