"""Table readers and adapters that derive listings from the driver tables."""
