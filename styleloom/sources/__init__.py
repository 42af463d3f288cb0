"""Scans: markup, stylesheets, scripts, template modules."""
