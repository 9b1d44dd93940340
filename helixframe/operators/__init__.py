"""helixframe.operators."""
