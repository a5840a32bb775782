"""Composed jobs: operators chained from source to sink."""
