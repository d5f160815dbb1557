"""Waymark's sources."""
