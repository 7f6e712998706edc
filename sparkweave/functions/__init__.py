"""Column functions of the evidence graph."""
