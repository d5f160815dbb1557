"""Waymark's operators."""
