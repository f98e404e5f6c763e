"""Glyphkin: comparing printed documents by the shapes of their letters, on Spark."""
