"""Operators on texts and for building training sets. Nothing outside this package imports it."""
