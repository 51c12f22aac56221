"""Readers and writers: registries, append-only logs, file trees, schema documents and mapper source."""
