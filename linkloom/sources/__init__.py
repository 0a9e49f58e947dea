"""Readers and writers of the text and columnar formats."""
