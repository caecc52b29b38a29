"""Readers, assemblers and sinks of panel tables."""
