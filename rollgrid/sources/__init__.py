"""Readers and writers: sheets, snapshots, event streams, idempotent sinks."""
