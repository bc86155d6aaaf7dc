"""Tables over parsed documents, in DataFrame operations."""
