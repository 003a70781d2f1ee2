"""Incremental views over an append-only commit feed."""
