"""Synthetic-population world analytics as Spark DataFrame operators."""

from popatlas.model import EventLog, World

__all__ = ["EventLog", "World"]
