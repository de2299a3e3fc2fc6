"""Incremental intake of a landing folder."""
