"""Operators for training-data pipelines: documents, pages and benchmarks at corpus scale."""
