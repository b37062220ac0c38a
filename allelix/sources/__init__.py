"""Readers of sequence files and lists."""
