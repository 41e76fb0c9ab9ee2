"""Readers and writers for snapshots, wordlists, robots files, sitemaps, logs and reports."""
