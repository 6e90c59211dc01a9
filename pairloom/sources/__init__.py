"""Reading, writing and resuming."""
