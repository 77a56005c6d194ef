"""Types, name rules and column functions."""
