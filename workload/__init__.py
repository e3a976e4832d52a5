"""Queries over the shared tables: log lines and a device tree are derived from `events`."""
