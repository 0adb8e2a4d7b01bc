"""functions of the graph engine."""
