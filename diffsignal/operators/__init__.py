"""Operators over DataFrames: chunking, retrieval, signals, context, metrics, symbols, snapshots."""
