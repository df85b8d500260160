"""Structured Streaming: journal windows and idempotent upserts."""
