"""Readers and writers of the engine's tables and of the file formats that evidence comes in."""
