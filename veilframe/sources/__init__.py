"""sources of veilframe."""
