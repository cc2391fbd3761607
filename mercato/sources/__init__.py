"""Readers of platform exports and the benchmark fixture views."""
