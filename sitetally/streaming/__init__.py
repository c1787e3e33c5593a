"""Structured Streaming form: reports produced as monthly uploads land."""
