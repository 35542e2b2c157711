"""Incremental landing of usage files with Structured Streaming."""
