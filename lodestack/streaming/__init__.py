"""Files and events as streams."""
