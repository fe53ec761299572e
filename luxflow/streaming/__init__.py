"""Operators on live recordings."""
