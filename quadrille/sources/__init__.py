"""sources of the graph engine."""
