"""Sources: readers of transcript files, and a registry of them by name."""
