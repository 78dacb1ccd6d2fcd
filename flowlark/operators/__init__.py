"""Operators on packet, session, cluster and behaviour tables."""
