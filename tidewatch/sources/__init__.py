"""Readers, writers and record parsers."""
