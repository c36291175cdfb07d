"""Readers of manifests, media files and metric files."""
