"""Corpus preparation for language-model training: thirteen operators and their registered queries.

Nothing outside this package imports it; see ``registry.py`` for the queries and their SQL.
"""
