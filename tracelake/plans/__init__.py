"""Signal-processing stages, their provenance and the chain that composes them."""
