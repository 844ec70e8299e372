"""Incremental audits of a folder that files are added to."""
