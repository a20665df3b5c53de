"""Outputs: lines as parts of texts, and texts as files."""
