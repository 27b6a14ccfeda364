"""functions of larkspur."""
