"""Part of the project catalogue: streaming."""
