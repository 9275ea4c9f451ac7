"""Readers and writers of crawl logs, label taxonomies, benchmarks and reports."""
