"""Structured Streaming versions of the operators and the live job."""
