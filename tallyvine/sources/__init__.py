"""Readers and writers of the catalog, label, manifest and prediction files."""
