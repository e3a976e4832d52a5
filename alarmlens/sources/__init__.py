"""Readers for log lines, payloads, topology documents and patterns, and sinks."""
