"""Project search and exploration on Spark."""
