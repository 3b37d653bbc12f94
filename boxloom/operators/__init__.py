"""Relational operators on label, registry and detection tables."""
