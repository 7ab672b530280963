"""Operators for training-data pipelines: dedup, scans, scoring, decontamination, mixing."""
