"""Column functions: text, n-gram overlap, normalisation, perturbation."""
