"""Graph preparation and algorithms as DataFrame programs."""
