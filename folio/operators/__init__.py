"""Operators on documents: joins, rows, validation, relations, policies, hooks, patches."""
