"""Versioned tables of chunks and index metadata."""
