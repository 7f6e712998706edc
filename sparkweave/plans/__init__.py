"""plans of the evidence graph."""
