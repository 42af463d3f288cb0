"""Operators over contexts and selectors."""
