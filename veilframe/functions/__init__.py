"""functions of veilframe."""
