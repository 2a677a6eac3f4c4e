"""Readers and writers for worlds, event logs, lookups and map features."""
