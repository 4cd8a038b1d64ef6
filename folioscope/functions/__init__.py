"""Column functions, and the few text functions that need Python."""
