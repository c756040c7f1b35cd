"""Messages as they arrive."""
