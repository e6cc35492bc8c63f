"""Structured Streaming into a store."""
