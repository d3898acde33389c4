"""Column functions over kernel names and durations."""
