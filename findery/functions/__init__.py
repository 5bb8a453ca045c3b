"""Part of the project catalogue: functions."""
