"""DataFrame operators of the audit engine."""
