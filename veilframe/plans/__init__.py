"""plans of veilframe."""
