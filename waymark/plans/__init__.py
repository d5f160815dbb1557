"""Waymark's plans."""
