"""Analytics of audit, query and error logs."""
