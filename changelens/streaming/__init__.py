"""Watching for changed files with Structured Streaming."""
