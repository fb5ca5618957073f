"""Readers and writers: site files, reports, artifacts, image archives."""
