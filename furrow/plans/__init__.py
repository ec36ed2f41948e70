"""Domain jobs composed from the operators."""
