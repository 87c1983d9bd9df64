"""The snapshot log: where rows and commits are written and read back."""
