"""helixframe.functions."""
