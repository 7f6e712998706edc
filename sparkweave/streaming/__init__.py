"""streaming of the evidence graph."""
