"""Operators on texts and record linkage; nothing else in the library imports this subpackage."""
