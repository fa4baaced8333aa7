"""Column expressions: time, weather, solar geometry, scores."""
