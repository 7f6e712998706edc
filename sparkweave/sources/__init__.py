"""sources of the evidence graph."""
