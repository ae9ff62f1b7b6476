"""Rule compilation, fixpoints, cuts and the registered queries."""
