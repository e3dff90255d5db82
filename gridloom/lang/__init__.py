"""Lexer, syntax tree and parser of the query language."""
