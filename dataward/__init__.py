"""Governed DataFrame access, audit and operational analytics on Spark."""
