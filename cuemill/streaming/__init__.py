"""Incremental variants of the frame and word flows."""
