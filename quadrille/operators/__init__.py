"""operators of the graph engine."""
