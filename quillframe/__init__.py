"""Corpus analytics on Spark: scans, joins, ranking, text mining, graphs, scoring and data-quality rules."""
