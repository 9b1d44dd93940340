"""helixframe.sources."""
