"""Logs, runs and write-ahead segments as DataFrames."""
