"""Column expressions: listing fields and title attributes. No UDFs."""
