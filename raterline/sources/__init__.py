"""Reading inputs and bringing them to canonical observations."""
