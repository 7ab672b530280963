"""prismcat: embedding-catalogue analytics as plain DataFrame -> DataFrame functions."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
