"""Part of the project catalogue: operators."""
