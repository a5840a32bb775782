"""Telemetry failure analytics expressed as Spark DataFrame operators."""

from failwatch.settings import Settings

__all__ = ["Settings"]
