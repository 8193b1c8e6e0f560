"""Readers and writers of books, scripts, manifests and glossaries."""
