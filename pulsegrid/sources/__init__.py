"""Readers and writers: source and channel lists, feeds, logs, the fixture's tables under the engine's names."""
