"""Readers, schemas, day grids and sinks."""
