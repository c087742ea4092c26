"""Whole studies: operators in sequence, with a stored table after each stage."""
