"""Variant analytics as DataFrame plans."""
