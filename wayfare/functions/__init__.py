"""Column helpers and the shared ranking and running-total building blocks."""
