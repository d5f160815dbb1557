"""Waymark's streaming."""
