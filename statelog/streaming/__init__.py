"""Micro-batch ingestion on Structured Streaming."""
