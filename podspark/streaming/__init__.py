"""Incremental jobs over landing folders."""
