"""Repositories, transactions and composed queries."""
