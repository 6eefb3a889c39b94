"""Whole jobs: settings, state tables, and the import of files."""
