"""Live observation of a run."""
