"""DataFrame to DataFrame."""
