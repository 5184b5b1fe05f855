"""Operators for large text and code collections. Nothing outside this subpackage imports it."""
