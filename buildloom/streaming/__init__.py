"""Logs that keep growing, read as streams."""
