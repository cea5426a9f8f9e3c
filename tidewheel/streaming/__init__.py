"""Inspection of streams."""
