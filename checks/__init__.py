"""Independent SQL for the results the plans must give."""
