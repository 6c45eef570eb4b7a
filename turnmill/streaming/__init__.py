"""Structured Streaming: stateful sessions, budgets and telemetry."""
