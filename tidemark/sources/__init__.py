"""Readers, writers and nested-row helpers."""
