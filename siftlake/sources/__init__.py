"""Readers and writers of the audit tables."""
