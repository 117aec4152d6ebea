"""Rule tables: what to look for, under which name, with which score."""
