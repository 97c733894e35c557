"""Structured Streaming: continuous scoring and a running sentiment distribution."""
