"""Sources, sinks and formats."""
