"""streaming of veilframe."""
