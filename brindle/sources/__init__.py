"""Scans, sinks and table storage."""
