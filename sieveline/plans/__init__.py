"""Helpers that shape or cut plans."""
