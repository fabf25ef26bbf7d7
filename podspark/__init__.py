"""Batch and incremental Spark jobs for podcast intelligence at scale."""
