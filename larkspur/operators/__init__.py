"""operators of larkspur."""
