"""Column helpers and distributed positions shared by the operators."""
