"""Structured Streaming training and scoring."""
