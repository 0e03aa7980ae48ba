"""Readers and writers of point and matrix tables."""
