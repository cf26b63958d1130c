"""Readers and writers of graph formats."""
