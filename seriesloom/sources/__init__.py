"""Readers, literal lookup tables and staged tables."""
