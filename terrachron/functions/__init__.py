"""Column expressions only: nothing in here triggers a job or a shuffle."""
