"""Readers and writers with checked schemas."""
