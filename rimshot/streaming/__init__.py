"""Structured Streaming jobs over landed files (X1 quote snapshots, X2 daily game loads)."""
