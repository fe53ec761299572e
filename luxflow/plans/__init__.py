"""Recordings and samples made of several streams."""
