"""Part of the project catalogue: plans."""
