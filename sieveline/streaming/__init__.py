"""Incremental and streaming forms of the batch operators."""
