"""Scans of landed files into tables."""
