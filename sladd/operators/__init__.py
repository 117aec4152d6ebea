"""DataFrame operators built on the column functions."""
