"""Workbooks from tables, CSV and spreadsheets; artifacts to JSON and ZIP."""
