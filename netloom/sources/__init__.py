"""Readers of raw payloads and writers of derived tables."""
