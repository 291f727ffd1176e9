"""Graph files, and graphs derived from relational tables."""
