"""SQL functions that users define."""
