"""Session and plan helpers."""
