"""Relational operators over versions."""
