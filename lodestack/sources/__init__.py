"""Binary files as tables."""
