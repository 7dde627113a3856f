"""Statistical operators on observations."""
