"""Readers and writers: binary traces, corpus lines, result documents, logs."""
