"""Readers, snapshots and sinks."""
