"""Readers (scans with declared schemas and cleaning), the test binding and sinks."""
