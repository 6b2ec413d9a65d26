"""Batch jobs that check column metadata and map it onto a dictionary of standards."""
