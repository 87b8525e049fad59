"""Column functions for validation and derived values."""
