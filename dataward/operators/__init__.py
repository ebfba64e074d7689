"""Filters, order and pages, counts, writes and joins, as functions of DataFrames."""
