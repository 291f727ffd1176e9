"""Edge maps, vertex maps, sequences and partitioners as DataFrame operations."""
