"""Readers and writers of trace files."""
