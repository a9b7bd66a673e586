"""Distributed operators: scoring expressions, sufficient statistics, sampling, seeding."""
