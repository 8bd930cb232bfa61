"""Readers of file formats: from bytes to entries.

A reader is a function of (bytes, Options) that yields Piece rows. What it yielded before it failed is kept; the caller
records the failure.
"""
