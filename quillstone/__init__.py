"""Quillstone: ordered-document analytics on Spark."""
