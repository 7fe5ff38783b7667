"""Readers, writers and fixture views."""
