"""Streaming: replay fitted recipes on Structured Streaming frames."""
