"""Structured Streaming forms of the operators, their sinks and the wiring."""
