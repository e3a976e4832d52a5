"""Composite jobs: inference, batch pipeline, reports, payloads."""
