"""operators of the evidence graph."""
