"""Whole computations over the engine's tables: serving, scoring, ingest. 'now' is always a parameter."""
