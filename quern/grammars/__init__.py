"""Grammars of six languages, their lexers, and the generalised parsers that run them."""
