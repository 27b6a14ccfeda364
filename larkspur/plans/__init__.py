"""plans of larkspur."""
