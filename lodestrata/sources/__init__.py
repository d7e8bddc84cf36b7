"""Readers of the formats the site corpus comes in."""
