"""Operators for training-data pipelines: dedup, token counting, packing, scans."""
