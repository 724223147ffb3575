"""Reading, building and writing count tables."""
