"""Readers and writers for landed files and domain tables."""
