"""Alignment files to tables, and tables to files."""
