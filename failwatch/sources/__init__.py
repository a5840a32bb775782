"""Readers that produce the samples table."""
