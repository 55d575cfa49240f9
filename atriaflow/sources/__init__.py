"""Readers of vendor exports and writers of tables."""
