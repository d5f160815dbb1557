"""Waymark's functions."""
