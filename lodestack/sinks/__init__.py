"""Tables to binary files."""
