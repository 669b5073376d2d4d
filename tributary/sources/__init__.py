"""Readers and writers: artifacts, project trees, driver tables, reports."""
