"""Workbooks as streams."""
