"""Scans, guards, fingerprints and sinks."""
