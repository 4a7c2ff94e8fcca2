"""Content-identity analytics as Spark queries."""
