"""Readers and batches over sheets."""
