"""Plans: graph tables and their expansion."""
