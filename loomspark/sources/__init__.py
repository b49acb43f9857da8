"""Readers of files and pages, and sinks."""
