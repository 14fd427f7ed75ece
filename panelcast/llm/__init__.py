"""Operators for preparing text corpora: joins, scans, filters, counts and packing."""
