"""Column expressions over cell texts and numbers."""
