"""Scans, listings and sinks."""
