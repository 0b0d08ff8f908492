"""Readers and writers for text, pairs, logs, token blocks and reports."""
