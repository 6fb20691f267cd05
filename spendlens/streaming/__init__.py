"""Incremental maintenance of the monthly cube with Structured Streaming."""
