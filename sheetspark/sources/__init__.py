"""Readers of sheets, workbooks and payloads."""
