"""Commit log, schemas and segment files."""
