"""DataFrame operators over frame tables, keyed by log."""
