"""Readers: document bytes to relations."""
