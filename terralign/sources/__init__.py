"""Binary and text sources, and sinks."""
