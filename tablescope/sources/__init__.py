"""Reading flat tables and keeping findings on disk."""
