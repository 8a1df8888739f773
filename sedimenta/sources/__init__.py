"""Where data comes from and goes to: files, versioned tables and their metadata."""
