"""Readers: partition-pruned scans, landed files, cubes."""
