"""Readers for landed poll payloads."""
