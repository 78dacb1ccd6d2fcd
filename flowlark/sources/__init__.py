"""Readers and adapters that give packet tables."""
