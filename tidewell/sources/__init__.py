"""Delimited files, spreadsheets, paged REST services, and folders of files."""
