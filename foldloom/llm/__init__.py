"""Operators for preparing corpora; nothing outside this folder imports it."""
