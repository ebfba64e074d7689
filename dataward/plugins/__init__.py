"""Plugins that govern tables as they are opened and written."""
