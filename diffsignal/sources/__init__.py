"""Readers that turn files, git trees, diffs and provider payloads into DataFrames."""
