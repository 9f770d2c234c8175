"""operators of veilframe."""
