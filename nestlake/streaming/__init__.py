"""Event tables that grow: additions beside the operators on finite tables."""
