"""helixframe.plans."""
