"""Sources: a source tree as a table, and syntax extraction from its files."""
