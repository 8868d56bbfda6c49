"""Incremental counterparts of the tap summaries for streaming tap sources."""
