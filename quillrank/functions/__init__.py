"""Column expressions over text, JSON and scores."""
