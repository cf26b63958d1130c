"""The graph model and the superstep runtime."""
